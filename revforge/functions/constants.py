"""Fixed values. These must stay exactly as written for results to match the behaviour being rebuilt."""

# ---- fixed values: review labels -------------------------------------------------------------
# Class names and their integer codes (anything else, null included, gets the last code).
LABEL_CODES = {"bug report": 0, "feature request": 1, "rating": 2, "user experience": 3}
OTHER_CODE = 3
# Short codes used by the raw source and the names they stand for.
SHORT_CODES = {"PD": "bug report", "RT": "rating", "UE": "user experience", "FR": "feature request"}
# Order of the four 0/1 flag columns in a multi-label table.
FLAG_ORDER = ["bug report", "user experience", "rating", "feature request"]
# Order of the classes in a printed / wide report.
REPORT_ORDER = ["bug report", "feature request", "rating", "user experience"]
# Order in which per-class counts are printed.
COUNT_PRINT_ORDER = [0, 2, 1, 3]
# Strings a CSV reader treats as missing.
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# ---- fixed values: English stop words (lower case, natural order) ------------------------------
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll",
    "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "she's",
    "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "that'll", "these", "those", "am",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while",
    "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during",
    "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don",
    "don't", "should", "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren",
    "aren't", "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn",
    "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't",
    "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren",
    "weren't", "won", "won't", "wouldn", "wouldn't",
]

# ---- fixed values: noun suffix rules for lemmas (suffix, replacement), in rule order ----------
NOUN_SUFFIX_RULES = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
    ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
]

# ---- fixed values: hyper-parameter search space and budget -----------------------------------
SEARCH_SPACE = {
    "learning_rate": ("uniform", 1e-5, 5e-5),
    "weight_decay": ("uniform", 0.01, 0.2),
    "epochs": ("int", 3, 5),
    "train_batch": ("log-int", 8, 32),
    "eval_batch": ("log-int", 8, 64),
}
SEARCH_CALLS = 20
SEED = 42
TEST_SHARE = 0.2
DECISION_THRESHOLD = 0.5
MAX_TOKENS = 128
