"""Fixed values that results depend on."""

# Words that carry no topic.
STOPWORDS = """
a about after all also an and any are as at be been being both but by can could did do does each either for from get
had has have how i if in into is it its just me may might more most must my no not of on only or other our own s shall
should so some such than that the their them then there these they this those to up used very was we were what when
where which while who whom whose why will with would you your
""".split()

# Irregular forms and their base forms.
IRREGULAR = dict(
    pair.split(":")
    for pair in """
lost:lose found:find made:make paid:pay bought:buy sent:send spent:spend kept:keep left:leave held:hold built:build
brought:bring taught:teach thought:think caught:catch sold:sell told:tell given:give gave:give taken:take took:take
written:write wrote:write chosen:choose chose:choose began:begin begun:begin ran:run seen:see saw:see went:go gone:go
known:know knew:know shown:show grew:grow grown:grow drew:draw drawn:draw met:meet led:lead fed:feed fell:fall
fallen:fall broke:break broken:break spoke:speak spoken:speak stole:steal stolen:steal froze:freeze frozen:freeze
rode:ride ridden:ride drove:drive driven:drive ate:eat eaten:eat understood:understand stood:stand meant:mean felt:feel
dealt:deal
""".split()
)

# Abbreviations after which a period ends no sentence.
ABBREVIATIONS = frozenset(
    """
e.g i.e etc vs cf al fig figs eq eqs sec secs tab ref refs no nos vol pp p ch approx dr mr mrs ms prof inc ltd co corp
jr sr st dept univ est min max avg resp incl jan feb mar apr jun jul aug sep sept oct nov dec
""".split()
)

# Words whose numeral label may end a sentence ("Table I.").
LABEL_WORDS = """
table figure fig section sec appendix chapter part phase type class group stage level step plan option category grade
model exhibit schedule annex article volume vitamin
""".split()

# Words that ask for an overview or name the document itself.
OVERVIEW_WORDS = """
summarize summarise summary summaries summarization overview overall explain explanation describe description detail
details detailed crucial important importance key main major point points finding findings takeaway takeaways highlight
highlights idea ideas gist tldr tl dr brief briefly short quick quickly simple simply everything whole entire paper
document doc docs file pdf article report study text book content contents topic topics cover covers say says discuss
discusses talk talks tell give show list outline contribution contributions conclusion conclusions abstract purpose goal
goals aim aims objective objectives learn know need please thing things understand basically mean means essential
essentials significant significance core central primary basic basics happen happens going general generally everyone
anything something interesting notable noteworthy recap review rundown breakdown digest
""".split()

# Words that shape a question, weighing little.
FILLER_WORDS = """
handle handled work worked works use using perform performed performs do done make made provide provided include
included includes contain contains consist consists involve involved mean happen happened obtain obtained get got take
taken achieve achieved store stored keep kept need needed require required support supported affect affected compare
compared differ different difference between among during within against best better most many much long often various
type types kind kinds way ways exactly actually really currently specific specifically record recorded
""".split()

# Patterns, case-insensitive unless said otherwise.
OVERVIEW_PATTERN = (
    r"\b(summar(y|ise|ize|ies)|overview|tl;?dr|gist|in a nutshell|key (points?|findings?|takeaways?|ideas?|details?)"
    r"|main (points?|ideas?|findings?|contributions?|takeaways?)|takeaways|highlights|crucial"
    r"|what('s| is| are) (this|these|the|it)( \w+)? about|what does (it|this|the \w+) (say|cover|discuss))\b"
)
EXPLANATORY = r"\b(explain|describe|why|details?|elaborate|walk me through)\b|\bhow (do|does|did|is|are|was|were|can|could|should|would|to)\b"
QUANTITATIVE = (
    r"\b(how (many|much|long|far|fast|big|large|often)|what (is|was|are|were) the \w*\s*(range|rate|error|rmse|accuracy|size|speed"
    r"|frequency|resolution|number|value|count|percentage|time|duration|distance|length|weight|cost|price|fee|score))\b"
    r"|\b(rmse|accuracy|percentage|frequency|resolution)\b"
)
FOCUS = r"\b(?:what|which|how many|how much)\s+(?:(?:is|are|was|were|does|do|did)\s+)?(?:(?:the|a|an)\s+)?([a-zA-Z0-9-]+)"
REFERENCES_HEADING = r"(^|› )([\dIVX]+\.?\s+)?(references|bibliography|works cited)$"
ASKS_ABOUT_REFERENCES = r"\b(references?|cit(e|es|ed|ation|ations)|bibliography|et al|prior work|related work)\b"
ABSTRACT_HEADING = r"(^|› )(abstract|summary|executive summary|overview)$"
INTRO_HEADING = r"(^|› )([\dIVX]+\.?\s+)?(introduction|background|purpose)\b"
CONCLUSION_HEADING = r"(^|› )([\dIVX]+\.?\s+)?(conclusions?|concluding|summary|discussion|future work|limitations)\b"
BACK_MATTER_PATH = r"(^|› )([\dIVX]+\.?\s+)?(references|bibliography|works cited|acknowledge?ments?|appendix)"
BACK_MATTER_HEADING = r"^([\dIVX]+\.?\s+)?(references|bibliography|works cited|acknowledge?ments?|appendix)\b"
BACK_MATTER_SECTION = r"^(references|bibliography|works cited|acknowledge?ments?|appendix)"
CUE_PHRASES = (
    r"\b(we (present|propose|introduce|show|find|found|observe|observed|provide|demonstrate|describe)"
    r"|our (results|findings|analysis|evaluation|dataset|method|approach)|in (summary|conclusion)|key findings?"
    r"|main contributions?|this (paper|work|study|dataset|report|document|handbook)|the (aim|goal|purpose|objective) of)\b"
)
SUMMARY_SECTIONS = r"\b(abstract|introduction|overview|summary|conclusions?|discussion|results|findings|contributions?)\b"
NOT_PROSE = r"https?://|@\w+\.\w|^\[\d+\]|^[^.;]{1,40}: [^;]*;"
MEASUREMENT = r"\d(\.\d+)?\s?(%|percent|m\b|cm\b|km\b|hz\b|ms\b|s\b|kg\b|°|x\b|times\b|fps\b|gb\b|mb\b|\$|£|€)|[$£€]\s?\d"
TABLE_LINE = r"^[^.;]{1,60}: [^;]*;| \| "
LIST_LINE = r"^([-*•]|\d{1,3}[.)])\s+"
QUESTION_COLUMNS = "question questions prompt prompts query queries text item q".split()

GENERAL_SECTION = (
    r"^(abstract|summary|introduction|background|related work|conclusions?|discussion|references|bibliography"
    r"|acknowledge?ments?|appendix.*|contents|overview|system overview)$"
)

# Where a sentence may end, the word before its period, and a label before a numeral.
SENTENCE_END = r"""([.!?])(["'”’)\]]*)\s+(?=["'“‘(\[]?[A-Z0-9])"""
LAST_WORD = r"""(?:^|[\s(\[])([A-Za-z][A-Za-z.]*)\.["'”’)\]]*$"""

NOT_FOUND = "The provided documents do not contain enough information to answer this question."

# Parts of words that keep their hyphen at a line break.
COMPOUND_SUFFIXES = """
based level like specific driven free aware oriented scale related dependent independent friendly ready sized shaped
wide rich intensive efficient aided enabled assisted centric agnostic defined made built known term time range
resolution frequency dimensional order art
""".split()
COMPOUND_PREFIXES = """
well self non multi real high low long short state two three four five single cross end user time close open half full
top bottom front back side world data sensor general large small hand pre post anti semi sub co
""".split()

# Patterns of positioned text.
LIST_MARKER = r"(?i)^(\(?([ivx]{1,5}|[a-h]|\d{1,2})\)|\[\d{1,3}\]\s|[•▪◦●‣∙]|[-–]\s)"
SECTION_NAMES = (
    r"(?i)^(abstract|introduction|background|related work|method(s|ology)?|results|discussion|conclusions?"
    r"|acknowledge?ments?|references|bibliography|appendix( [A-Z])?)$"
)
CAPTION = r"(?i)^(fig\.?|figure|table|tab\.)\s*[\dIVX]+[a-z]?\s*[:.|]"
NUMBERED_HEADING = r"^((\d{1,2}(\.\d{1,2}){0,3})|[IVXLC]{1,6}|[A-Z])[.)]?\s+[A-Z]"
PAGE_NUMBER = r"(?i)^(page\s*)?#?\d{1,4}(\s*(of|/)\s*\d{1,4})?$"

# What each mark of Markdown is replaced by, in order.
MARKDOWN_MARKS = (
    (r"(?m)^```[^\n]*\n([\s\S]*?)^```[ \t]*$", "$1"),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"(?m)^[ \t]{0,3}#{1,6}[ \t]+", ""),
    (r"(?m)[ \t]+#+[ \t]*$", ""),
    (r"(?m)^[ \t]{0,3}>[ \t]?", ""),
    (r"(?m)^[ \t]{0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$", ""),
    (r"\*\*([^*\n]+)\*\*", "$1"),
    (r"__([^_\n]+)__", "$1"),
    (r"(^|[^\w*])\*([^*\n]+)\*(?=[^\w*]|$)", "$1$2"),
    (r"(^|[^\w_])_([^_\n]+)_(?=[^\w_]|$)", "$1$2"),
    (r"`([^`\n]+)`", "$1"),
    (r"(?m)^[ \t]*[-*+][ \t]+", "- "),
    (r"</?[a-zA-Z][^>]*>", ""),
)
