"""quillbar: dated headlines and daily price bars, analysed on Spark."""
