import math
import re
from collections import Counter, defaultdict

import regex

from tessella.llm import quality


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def js(p, q):
    part = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum(0.5 * part(a, b) + 0.5 * part(b, a) for a, b in zip(p, q, strict=True))))


def classes(t):
    out = []
    for _, pattern in quality.CLASSES:
        left = regex.sub(pattern, "", t)
        out.append(len(t) - len(left))
        t = left
    return [*out, len(t)]


def test_counts_and_distances_against_brute_force(spark):
    clean = ["the cat and the dog of a house in the end was at it " * n for n in (1, 6, 9)] + [f"this is line {i} of the text, and so it goes on to the end\n" * 3 for i in range(12)]
    odd = ["", None, " \t\n", "a b a b a b c", "X### " * 80, "ABC!! DEF!! " * 60, "é ü \U0001f600 x", "a\n\nb\na \na\nb", "w " * 49, " ".join(f"u{i}" for i in range(400)), "long text of many words " * 4000, "everywhere something different happens " * 60]
    texts = clean + odd
    df = spark.createDataFrame([(i, t, "en" if i % 5 else None, "q") for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept string")
    got = {r.doc_id: r for r in quality.judge(df, min_ref_tokens=100).collect()}
    words, chars = defaultdict(Counter), defaultdict(lambda: [0] * 7)
    for i, t in enumerate(texts):
        lang = "en" if i % 5 else ""
        words[lang].update(x for x in regex.split(r"[^\p{L}]+", (t or "").lower()) if x)
        chars[lang] = [a + b for a, b in zip(chars[lang], classes(t or ""), strict=True)]
    for i, t in enumerate(texts):
        r, lang = got[i], "en" if i % 5 else ""
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t), i
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        total = sum(words[lang].values())
        top = sorted((-n, w) for w, n in words[lang].items())[:30]
        mine = [x for x in regex.split(r"[^\p{L}]+", (t or "").lower()) if x]
        q = [-n / total for n, _ in top]
        p = [mine.count(w) / max(1, len(mine)) for _, w in top]
        word = js([*p, 1 - sum(p)], [*q, max(0.0, 1 - sum(q))]) if len(mine) >= 40 else None
        own = classes(t or "")
        kind = js([c / max(1, sum(own)) for c in own], [c / sum(chars[lang]) for c in chars[lang]]) if sum(own) >= 200 else None
        for have, want in ((r.word_js, word), (r.class_js, kind)):
            assert (have is None) == (want is None) and (want is None or abs(have - want) < 1e-6), (i, have, want)
        assert r.base_failed == failed
        assert r.kept == (not failed and (kind is None or kind <= quality.MAX_CLASS) and (word is None or word <= quality.MAX_WORD))


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
