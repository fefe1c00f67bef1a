"""Defaults and word lists that results depend on, and the wording of generated headlines."""

# Class labels, in class order: 0, 1, 2.
LABELS = ["negative", "neutral", "positive"]
# Position taken for each label.
SIGNALS = {"negative": -1, "neutral": 0, "positive": 1}

# Default symbols and date range.
SYMBOLS = ["AAPL", "MSFT", "GOOGL", "TSLA", "AMZN"]
START_DATE = "2020-01-01"
END_DATE = "2023-12-31"

# Share of each label among generated headlines.
LABEL_SHARES = {"positive": 0.4, "neutral": 0.3, "negative": 0.3}

# Headline keywords for each label.
KEYWORDS = {
    "positive": [
        "surge", "rally", "breakthrough", "outperform", "bullish",
        "growth", "profit", "revenue", "earnings beat", "upgrade",
    ],
    "negative": [
        "decline", "plunge", "crash", "bearish", "loss",
        "miss", "downgrade", "concern", "risk", "volatility",
    ],
    "neutral": [
        "report", "announcement", "quarterly", "analysis", "forecast",
        "outlook", "guidance", "conference", "meeting", "update",
    ],
}

# Sentence frames of the generated headlines: {s} is the symbol, {k} the keyword. Own wording; no result depends on it.
TEMPLATES = {
    "positive": [
        "Buyers return to {s}: {k}",
        "{s} ends the day with a {k}",
        "Desk note on {s}: {k} ahead",
        "{k} lifts {s} after the bell",
    ],
    "negative": [
        "Sellers press {s}: {k}",
        "{s} ends the week with a {k}",
        "Desk note on {s}: {k} feared",
        "{k} weighs on {s} after the bell",
    ],
    "neutral": [
        "{s} sets a date for its {k}",
        "{s}: {k} leaves the price where it was",
        "Desk note on {s}: {k} awaited",
        "{k} from {s} due tomorrow",
    ],
}
# Topics that may follow " with focus on ", and how often they do.
FOCUS_TERMS = ["order flow", "cash reserves", "unit sales", "hiring plans", "payout policy", "supply costs"]
FOCUS_SHARE = 0.3

# Price path: first price, yearly drift and volatility, jump chance and size.
BASE_PRICE = 100.0
DRIFT = 0.05
VOLATILITY = 0.2
JUMP_PROBABILITY = 0.1
JUMP_SIZE = 0.05
# Spread of open, high and low around the close.
OPEN_SPREAD = 0.01
WICK_SPREAD = 0.005
# Volume: level, growth over the range, seasonal swing, noise, floor.
BASE_VOLUME = 1000000
VOLUME_GROWTH = 0.2
VOLUME_SWING = 0.1
VOLUME_NOISE = 0.3
VOLUME_FLOOR = 100000
TRADING_DAYS = 252
# Effect of a day's mean label on the next day's price.
SENTIMENT_IMPACT = 0.02

# Terms that stop-word removal must keep.
PROTECTED_TERMS = [
    "bull", "bear", "rally", "crash", "surge", "plunge", "volatility",
    "earnings", "revenue", "profit", "loss", "growth", "decline",
    "upgrade", "downgrade", "outperform", "underperform", "buy", "sell",
    "hold", "target", "price", "stock", "shares", "market", "trading",
]

# Spark's English stop words.
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they",
    "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at",
    "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above",
    "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most",
    "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t",
    "can", "will", "just", "don", "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll",
    "i'd", "you'd", "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're",
    "they're", "i've", "we've", "you've", "they've", "isn't", "aren't", "wasn't", "weren't", "haven't",
    "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't", "shouldn't", "mustn't",
    "can't", "couldn't", "cannot", "could", "here's", "how's", "let's", "ought", "that's", "there's", "what's",
    "when's", "where's", "who's", "why's", "would",
]

# Keywords behind the three keyword flags.
EARNINGS_WORDS = ["earnings", "revenue", "profit", "loss", "quarterly", "annual"]
MERGER_WORDS = ["merger", "acquisition", "takeover", "buyout", "deal"]
REGULATORY_WORDS = ["sec", "fda", "regulation", "compliance", "investigation", "fine"]

# Noun endings and their replacements (published noun detachment rules).
NOUN_ENDINGS = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
    ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
]

# Valence rules (Hutto and Gilbert, 2014).
NEGATION_FACTOR = -0.74
BOOST_STEP = 0.293
VALENCE_ALPHA = 15.0
CAPITALS_STEP = 0.733
EXCLAMATION_STEP = 0.292
MOST_EXCLAMATIONS = 4
QUESTION_STEP = 0.18
QUESTION_MOST = 0.96
BEFORE_BUT = 0.5
AFTER_BUT = 1.5
NEVER_SO_FACTOR = 1.25
NEGATION_WORDS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt", "dont", "hadnt", "hasnt", "havent", "isnt",
    "mightnt", "mustnt", "neednt", "neither", "never", "none", "nope", "nor", "not", "nothing", "nowhere", "oughtnt", "rarely",
    "seldom", "shant", "shouldnt", "uhuh", "wasnt", "werent", "without", "wont", "wouldnt", "despite",
]
BOOSTER_WORDS = {
    **dict.fromkeys([
        "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply", "enormously", "entirely",
        "especially", "exceptionally", "extremely", "fabulously", "fully", "greatly", "highly", "hugely", "incredibly", "intensely",
        "majorly", "more", "most", "particularly", "purely", "quite", "really", "remarkably", "so", "substantially", "thoroughly",
        "totally", "tremendously", "uber", "unbelievably", "unusually", "utterly", "very"], BOOST_STEP),
    **dict.fromkeys([
        "almost", "barely", "hardly", "just enough", "kind of", "kinda", "less", "little", "marginally", "occasionally",
        "partly", "scarcely", "slightly", "somewhat", "sort of", "sorta"], -BOOST_STEP),
}
IDIOMS = {
    "the bomb": 3.0, "bad ass": 1.5, "yeah right": -2.0, "kiss of death": -1.5, "to die for": 3.0,
    "hand to mouth": -2.0, "upper hand": 1.0, "cut the mustard": 2.0, "back handed": -2.0,
}
VALENCE_CUT = 0.05

# Yearly risk-free rate and days per year in the strategy metrics.
RISK_FREE_RATE = 0.02
DAYS_PER_YEAR = 365.25

# Abbreviations (Kiss and Strunk, 2006): how often a period comes with one, and the least score.
ABBREVIATION_PERIOD_RATE = 0.99
ABBREVIATION_CUT = 0.3
# Words that Treebank tokens part after the third letter.
SPLIT_WORDS = ("cannot", "gimme", "gonna", "gotta", "lemme", "wanna")
