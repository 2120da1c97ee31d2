"""A small English sentiment lexicon, written for support tickets.

Polarity runs from -1 to 1.  A modifier acts on the word right after it; a
negator reaches one word further, over a modifier ("not very good").
"""

POLARITY = {
    # negative
    "awful": -1.0, "terrible": -1.0, "horrible": -1.0, "worst": -1.0, "worthless": -0.8, "useless": -0.5,
    "unacceptable": -0.7, "frustrated": -0.7, "frustrating": -0.4, "disappointing": -0.6, "disappointed": -0.75,
    "regret": -0.5, "crashing": -0.5, "crashes": -0.5, "broken": -0.4, "poor": -0.4, "bad": -0.7, "wrong": -0.5,
    "slow": -0.3, "failing": -0.5, "fails": -0.5, "failed": -0.5, "missing": -0.2, "cancel": -0.3, "refund": -0.3,
    "leaving": -0.3, "competitor": -0.2, "issues": -0.2, "problem": -0.3, "problems": -0.3, "twice": -0.1,
    "expensive": -0.5, "annoying": -0.8, "angry": -0.5, "hate": -0.8, "unhappy": -0.6, "confusing": -0.3,
    "difficult": -0.5, "late": -0.3, "error": -0.3, "errors": -0.3, "bug": -0.3, "bugs": -0.3,
    # positive
    "great": 0.8, "love": 0.5, "loves": 0.5, "fantastic": 0.6, "satisfied": 0.5, "thank": 0.3, "thanks": 0.3,
    "quick": 0.3, "appreciated": 0.4, "excellent": 1.0, "perfectly": 1.0, "perfect": 1.0, "helpful": 0.5,
    "recommend": 0.4, "good": 0.7, "better": 0.5, "best": 1.0, "nice": 0.6, "easy": 0.4, "happy": 0.8,
    "wonderful": 1.0, "amazing": 0.6, "awesome": 1.0, "impressed": 0.5, "reliable": 0.4, "fast": 0.2,
    "improved": 0.2, "enjoy": 0.4, "pleased": 0.5, "smooth": 0.4,
}

INTENSIFIERS = {
    "very": 1.3, "extremely": 1.5, "really": 1.2, "too": 1.1, "so": 1.1, "highly": 1.3, "totally": 1.3,
    "slightly": 0.6, "somewhat": 0.7, "fairly": 0.8, "barely": 0.4,
}

NEGATORS = ["not", "no", "never", "none", "isn't", "aren't", "wasn't", "don't", "doesn't", "didn't", "can't", "won't", "cannot"]
NEGATION = -0.5
