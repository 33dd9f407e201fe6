import random

from tessella.llm import licenses

MIT, GPL = licenses.NOTICES[0][1], next(t for n, t in licenses.NOTICES if n == "gpl")


def base(text):
    words, found = licenses.split_words(text or ""), []
    for label, phrase in licenses.PHRASES:
        p = licenses.split_words(phrase)
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({n for _, n in found}))


def scan(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return licenses.scan(docs, **how).collect()


def test_phrases_against_brute_force(spark):
    rng = random.Random(9)
    words = ["under", "the", "MIT", "license", "License,", "apache", "version", "2", "2.0", "CC", "BY", "NC", "by-nc", "é", "\n", "booK"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(60))) for _ in range(200)]
    texts += [None, "", "CC BY-NC", "cc by nc cc by nc cc by nc", "under the mit licenſe", "Under-The_MIT!LICENSE", "xunder the mit license", "ÉMIT under the mit license é", "cc_by_nc\x00cc\x7fby\tnc", "by nc", "apache license version 2" * 3, "cc by nc " * 20_000, "plain " * 50_000 + "Released under the MIT License."]
    rows = [*enumerate(texts), (None, "CC BY-NC 4.0"), (3, "under the MIT license"), (3, "under the MIT license")]
    got = scan(spark, rows)
    want = [(i, *base(t)) for i, t in rows]
    have = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got]
    assert sorted(map(str, have)) == sorted(map(str, want))
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.n_base == 0 or r.score == 1)


def test_notices_with_changed_lost_and_inserted_words(spark):
    words = MIT.split()
    changed, lost, more, cut = list(words), list(words), list(words), words[: len(words) // 2]
    changed[5], changed[30] = "other", "thing"
    del lost[10:13]
    more[20:20] = ["as", "we", "said"]
    around = lambda x: "some text before it " + " ".join(x) + " and after it"
    rows = [(0, around(words)), (1, around(changed)), (2, around(lost)), (3, around(more)), (4, around(cut)), (5, around(random.Random(1).sample(words, len(words)))), (6, around([*words, *GPL.split()])), (7, around(["cc", "by", "nc", *words]))]
    got = {r.doc_id: r for r in scan(spark, rows)}
    assert [got[i].labels for i in range(8)] == ["mit", "mit", "mit", "mit", "", "", "gpl,mit", "cc-by-nc,mit"]
    assert got[0].score == 1 and all(0.8 <= got[i].score < 1 for i in (1, 2, 3)) and got[7].base_labels == "cc-by-nc"
    assert all(got[i].n_base == 0 and got[i].first_word is None for i in range(7))


def test_every_number_of_lost_words_up_to_the_similarity(spark):
    """The bound on votes loses no span: brute force over the covered words of every deletion."""
    words = licenses.split_words(MIT)
    rows = [(i, " ".join(words[:at] + words[at + n :])) for i, (at, n) in enumerate((at, n) for at in range(0, len(words) - 12, 3) for n in (1, 4, 9, 12))]
    got = {r.doc_id: r for r in scan(spark, rows)}
    for i, text in rows:
        covered, own = set(), text.split()
        for a in range(len(words) - 2):
            if any(own[p : p + 3] == words[a : a + 3] for p in range(len(own) - 2) if abs(p - a) <= 12):
                covered |= {a, a + 1, a + 2}
        assert (got[i].labels == "mit") == (len(covered) / len(words) >= 0.8)


def test_places_of_many_candidates_by_shuffle(spark):
    docs = spark.createDataFrame([(i, f"{i} under the MIT License") for i in range(50)], "doc_id long, text string")
    few = licenses.spans(docs, broadcast_rows=10).drop("__th", "__key")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, licenses.spans(docs).drop("__th", "__key").collect())) and few.count() == 50


def test_empty_table_and_short_templates(spark):
    import pytest

    assert scan(spark, []) == []
    with pytest.raises(ValueError):
        licenses.template_rows(notices=(("x", "these five words are few"),))
