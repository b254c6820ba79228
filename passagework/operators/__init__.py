"""Search, segmentation, summaries, answers, review and evaluation over DataFrames."""
