"""Porter's suffix-stripping algorithm (Program 14(3), 1980) with the usual later amendments.

A small helper for Arrow batches: results are memoised per worker, so the cost
follows the vocabulary a worker sees and not its number of tokens.
"""

from functools import lru_cache

# Words whose stem the rules do not reach, and the suffix tables.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
DERIVED = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "fulli": "ful",
}
SHORTENED = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
DROPPED = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
).split()


def _shape(word):
    """One letter per character: v for a vowel, c for a consonant; y is a vowel after c."""
    shape = ""
    for letter in word:
        vowel = letter in "aeiou" or (letter == "y" and shape.endswith("c"))
        shape += "v" if vowel else "c"
    return shape


def _measure(word):
    return _shape(word).count("vc")


def _short_end(word):
    shape = _shape(word)
    if len(word) == 2:
        return shape == "vc"
    return shape.endswith("cvc") and word[-1] not in "wxy"


def _longest(word, suffixes):
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(word):
    if word.endswith("ies"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("sses"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past_or_progressive(word):
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    suffix = _longest(word, ("ed", "ing"))
    if suffix is None or "v" not in _shape(word[: -len(suffix)]):
        return word
    stem = word[: -len(suffix)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem)[-1] == "c":
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem


def _final_y(word):
    if word.endswith("y") and len(word) > 2 and _shape(word)[-2] == "c":
        return word[:-1] + "i"
    return word


def _derived(word):
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    suffix = _longest(word, DERIVED)
    if suffix is None or _measure(word[: -len(suffix)]) == 0:
        return word
    changed = word[: -len(suffix)] + DERIVED[suffix]
    return _derived(changed) if suffix == "alli" else changed


def _shortened(word):
    suffix = _longest(word, SHORTENED)
    if suffix is None or _measure(word[: -len(suffix)]) == 0:
        return word
    return word[: -len(suffix)] + SHORTENED[suffix]


def _dropped(word):
    suffix = _longest(word, DROPPED)
    if suffix is None:
        return word
    stem = word[: -len(suffix)]
    allowed = suffix != "ion" or stem[-1:] in ("s", "t")
    return stem if allowed and _measure(stem) > 1 else word


def _final_letters(word):
    if word.endswith("e"):
        stem = word[:-1]
        measure = _measure(stem)
        if measure > 1 or (measure == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=1 << 18)
def stem(word):
    """Stem of one lower-case token; tokens of three letters or fewer stay as they are."""
    if len(word) <= 3:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    for step in (
        _plural, _past_or_progressive, _final_y, _derived, _shortened, _dropped, _final_letters,
    ):
        word = step(word)
    return word
