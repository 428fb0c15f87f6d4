"""The semantics stated in plain Python, for small fixtures."""

import math
import re
import string
from collections import Counter

UMLAUTS = {"ü": "ue", "Ü": "Ue", "ä": "ae", "Ä": "Ae", "ö": "oe", "Ö": "Oe", "ß": "ss"}
VOWELS = "aeiouyäöü"


def clean(text):
    text = re.sub(f"[{re.escape(string.punctuation)}]", " ", text).replace("\n", "")
    text = re.sub(r"[^\w\s]", "", text)
    for letter, pair in UMLAUTS.items():
        text = text.replace(letter, pair)
    return text.lower()


def snowball(word):
    letters = list(word.lower().replace("ß", "ss"))
    for i in range(1, len(letters) - 1):
        if letters[i] in "uy" and letters[i - 1] in VOWELS and letters[i + 1] in VOWELS:
            letters[i] = letters[i].upper()
    word = "".join(letters)

    def region(rest):
        found = re.match(f"[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]", rest, re.S)
        return found.end() if found else None

    first = region(word)
    second = None if first is None else region(word[first:])
    r1 = 10**6 if first is None else max(first, 3)
    r2 = 10**6 if second is None else first + second

    def ending(endings, start):
        for e in endings:
            if word.endswith(e) and len(word) - len(e) >= start:
                return e
        return ""

    e = ending(("ern", "em", "er", "en", "es", "e", "s"), r1)
    if e in ("en", "es", "e") and word[: len(word) - len(e)].endswith("niss"):
        word = word[: len(word) - len(e) - 1]
    elif e == "s":
        word = word[:-1] if word[-2] in "bdfghklmnrt" else word
    else:
        word = word[: len(word) - len(e)]
    e = ending(("est", "en", "er", "st"), r1)
    if e != "st" or (word[-3] in "bdfghklmnt" and len(word) >= 6):
        word = word[: len(word) - len(e)]
    e = ending(("isch", "lich", "heit", "keit", "end", "ung", "ig", "ik"), r2)
    if e:
        stem, inner = word[: len(word) - len(e)], word[r2 : len(word) - len(e)]
        if e in ("end", "ung"):
            word = stem[:-2] if inner.endswith("ig") and not inner.endswith("eig") else stem
        elif e in ("isch", "ig", "ik"):
            word = word if inner.endswith("e") else stem
        elif e in ("lich", "heit"):
            word = stem[:-2] if inner.endswith(("er", "en")) else stem
        else:
            word = stem[:-4] if inner.endswith("lich") else stem[:-2] if inner.endswith("ig") else stem
    return word.translate(str.maketrans("äöüUY", "aouuy"))


def cistem(word):
    word = word.lower().translate(str.maketrans("äöü", "aou")).replace("ß", "ss")
    if word.startswith("ge") and len(word) >= 6:
        word = word[2:]
    groups = (("sch", "$"), ("ei", "%"), ("ie", "&"))
    for group, symbol in groups:
        word = word.replace(group, symbol)
    word = re.sub(r"(.)\1", r"\1*", word)
    while len(word) > 3:
        if len(word) > 5 and word[-2:] in ("em", "er", "nd"):
            word = word[:-2]
        elif word[-1] in "tesn":
            word = word[:-1]
        else:
            break
    word = re.sub(r"(.)\*", r"\1\1", word)
    for group, symbol in groups:
        word = word.replace(symbol, group)
    return word


def cosine(query, texts):
    """Cosine of the query's and each text's counts; query words no text has are ignored."""
    bags = [Counter(re.findall(r"\w\w+", t)) for t in texts]
    known = set().union(*bags) if bags else set()
    q = Counter(w for w in re.findall(r"\w\w+", " ".join(query)) if w in known)
    qn = math.sqrt(sum(v * v for v in q.values()))
    out = []
    for bag in bags:
        n = math.sqrt(sum(v * v for v in bag.values()))
        out.append(sum(bag[w] * v for w, v in q.items()) / (n * qn) if n and qn else 0.0)
    return out


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else None


def section(parts, first, start=0, guarded=None, peek=None, sentinel="leer"):
    def whole(words):
        return re.compile(r"\b(" + "|".join(words) + r")\b", re.IGNORECASE)

    value = None
    for i in range(start, len(parts)):
        if len(parts[i]) >= 100:
            continue
        following = parts[i + 1] if i + 1 < len(parts) else None
        hit = whole(first).search(parts[i])
        hit = hit or ((guarded or {}).get(i) and whole(guarded[i]).search(parts[i]))
        hit = hit or (
            peek and following is not None
            and whole(peek).search(parts[i]) and whole(first).search(following[:50])
        )
        if hit:
            return following
        value = sentinel
    return value
