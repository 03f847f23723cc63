"""Statistics of texts against plain definitions: what is skipped for speed changes nothing."""

import math
import random
import re
from collections import Counter

from leafwright.llm import prose as P

SPLIT = re.compile(r"(?<=[.!?])[\s\"”»)]+|(?<=[。！？])|\n\s*\n")
AT = {k: i for i, k in enumerate(P.NAMES)}


def plain(text):
    n, tokens = len(text), text.split()
    words = P.WORD.findall(text)
    letters, cjk = sum(map(len, words)), len(P.CJK.findall(text))
    lines = [x for x in text.split("\n") if x.strip()] or [text]
    flat = re.sub(r"-\s*\n\s*", "", P.ENUMERATOR.sub(" ", P.LEADER.sub(" ", text)))
    flat = re.sub(r"\s*\n\s*", "" if cjk > letters * 0.3 and " " not in text.strip() else " ", flat)
    inside, lengths = 0, []
    for s in map(str.strip, SPLIT.split(flat)):
        found, wide = P.WORD.findall(s), len(P.CJK.findall(s))
        size = len(found) if wide < 0.3 * len(s) else wide / 2 if " " not in s else max(wide / 3, len(found))
        if s and s[-1] in P.ENDS and size >= 4 and sum(map(len, found)) > 0.55 * len(s):
            inside += len(s)
            lengths.append(size)
    counts = Counter(text)
    latin = [w for w in words if w.isascii() and len(w) > 1]
    return {
        "sentence_share": min(1.0, inside / max(1, len(flat.strip()))),
        "mean_sentence_words": sum(lengths) / len(lengths) if lengths else 0.0,
        "ends_per_100": 100 * len(re.findall(r"[!?。！？]|\.(?!\d)", flat)) / n,
        "entropy": -sum(v / n * math.log2(v / n) for v in counts.values()),
        "leader_ratio": sum(map(len, P.LEADER.findall(text))) / n,
        "number_token_share": sum(bool(P.NUMBER.fullmatch(t.strip("(),;:"))) for t in tokens) / max(1, len(tokens)),
        "cell_share": sum(bool(P.CELL.match(t)) for t in tokens) / max(1, len(tokens)),
        "camel_share": sum(bool(P.CAMEL.search(t)) for t in tokens) / max(1, len(tokens)),
        "consonant_share": sum(bool(P.CONSONANTS.search(w)) for w in latin) / max(1, len(latin)),
        "key_share": sum(bool(P.KEY.match(x)) for x in lines) / len(lines),
        "gap_share": sum(bool(P.GAP.search(x)) for x in lines) / len(lines),
        "upper_ratio": sum(v for c, v in counts.items() if c.isupper()) / max(1, letters),
    }


def test_statistics_match_plain_definitions():
    rng = random.Random(11)
    pieces = ["word", "Word", "str", "xkcdvb", "12", "3.5%", "(4)", "a.", "b)", "1.", "....", ". . . ", "-\n", "\n", "\n\n", "; ", ": ", "=", "  ", "\t", " ", " ", "n/a", "0x1f", "–", "camelCase", "é", "の", "文字", "。", "！", "? ", "! ", ". ", '." ', "가", "|", "É", "null", "：", "·····"]
    for _ in range(6000):
        t = "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(1, 30)))
        if t.strip():
            got = P.statistics(t)
            for k, v in plain(t).items():
                assert math.isclose(got[AT[k]], v, abs_tol=1e-9), (k, got[AT[k]], v, t)
