"""CSV of people's spreadsheets: found delimiter, quotes anywhere in a cell, ragged rows; and tables as labelled lines."""

from __future__ import annotations

import re

from ..functions.constants import QUESTION_COLUMNS


def detect_delimiter(text: str) -> str:
    """The most frequent of comma, semicolon and tab outside quotes in the first line; the earlier one on a tie."""
    line = re.sub(r'"[^"]*("|$)', "", text.partition("\n")[0].removesuffix("\r"))
    return max(",;\t", key=lambda d: (line.count(d), -",;\t".index(d)))


def parse(text: str, delimiter: str | None = None) -> list[list[str]]:
    """Rows of cells. A quote opens or closes a quoted stretch wherever it stands, two inside one are a quote; blank rows go."""
    text = text.removeprefix("﻿")
    delimiter = delimiter or detect_delimiter(text)
    rows: list[list[str]] = [[]]
    cell: list[str] = []
    quoted, at = False, 0
    while at < len(text):
        char = text[at]
        at += 1
        if char == '"':
            if quoted and text[at : at + 1] == '"':
                cell.append('"')
                at += 1
            else:
                quoted = not quoted
        elif not quoted and char == delimiter:
            rows[-1].append("".join(cell))
            cell.clear()
        elif not quoted and char in "\r\n":
            at += char == "\r" and text[at : at + 1] == "\n"
            rows[-1].append("".join(cell))
            cell.clear()
            rows.append([])
        else:
            cell.append(char)
    rows[-1].append("".join(cell))
    return [r for r in rows if any(c.strip() for c in r)]


def question_column(header: list[str]) -> int:
    """The first cell that names a column of questions, or -1."""
    return next((n for n, c in enumerate(header) if c.strip().lower() in QUESTION_COLUMNS), -1)


def questions(rows: list[list[str]], column: int | str | None = None, has_header: bool | None = None) -> list[str]:
    """The questions of a sheet, white space collapsed, blanks dropped; an unknown column name means the first column."""
    if not rows:
        return []
    guessed = question_column(rows[0])
    header = guessed >= 0 if has_header is None else has_header
    if isinstance(column, str):
        names = [c.strip().lower() for c in rows[0]]
        column = names.index(column.strip().lower()) if header and column.strip().lower() in names else 0
    elif column is None:
        column = max(0, guessed)
    cells = (" ".join(r[column].split()) for r in rows[header:] if 0 <= column < len(r))
    return [c for c in cells if c]


def write(rows: list[list[str]], delimiter: str = ",", protect: bool = True) -> str:
    """CSV with CRLF; cells that a spreadsheet would run as formulas get an apostrophe."""

    def cell(value: str | None) -> str:
        value = value or ""
        if protect and value[:1] and value[0] in "=+-@\t\r":
            value = "'" + value
        return '"' + value.replace('"', '""') + '"' if any(c in value for c in ('"', delimiter, "\r", "\n")) else value

    return "".join(delimiter.join(map(cell, r)) + "\r\n" for r in rows)


def table_lines(rows: list[list[str]]) -> list[str]:
    """A table as lines: "Header: value; …" under a header that looks like one, else cells joined by bars."""
    rows = [[" ".join(c.split()) for c in r] for r in rows]
    rows = [r for r in rows if any(r)]
    bars = [" | ".join(c for c in r if c) for r in rows]
    if len(rows) < 2:
        return bars
    header = rows[0]
    if not all(0 < len(c) <= 40 for c in header) or sum(bool(re.search(r"[0-9]", c)) for c in header) > len(header) // 3:
        return bars

    def pairs(cells: list[str]) -> str:
        return "; ".join(f"{h}: {c}" for h, c in zip(header, cells) if c)

    by_width = {len(header): pairs, len(header) + 1: lambda r: f"{r[0]} — {pairs(r[1:])}"}
    return [" | ".join(header), *(by_width[len(r)](r) if len(r) in by_width else bar for r, bar in zip(rows[1:], bars[1:]))]
