import math
import random

import numpy as np
import pytest

from tessera.llm import ann, decontaminate, html, jaccard, langid, lm_score, packing, pii, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, gone_id long"


def make(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in texts], DOCS)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and an extra column with a clashing name."""
    return make(spark, [(1, None), (2, ""), (3, "  "), (None, "no id at all"), (4, "same text here now"), (4, "same text here now"), (5, "word " * 60_000), (6, "!!!")])


def test_jaccard_finds_what_brute_force_finds(spark):
    rng = random.Random(3)
    base = [words(rng, 60).split() for _ in range(30)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        c = list(b)
        for _ in range(rng.randrange(1, 12)):
            c[rng.randrange(len(c))] = "changed"
        texts += [" ".join(c)] + ([" ".join(b)] if rng.random() < 0.3 else [])
    rows = list(enumerate(texts))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}
    joined = jaccard.jaccard_join(make(spark, rows)).collect()
    # pairs are those of representatives; members of their classes follow
    members = {i: {i} for i in range(len(rows))}
    for r in joined:
        if r["same_set"]:
            members[r["doc_a"]].add(r["doc_b"])
    got = {(min(x, y), max(x, y)) for r in joined for x in members[r["doc_a"]] for y in members[r["doc_b"]] | (members[r["doc_a"]] if r["same_set"] else set()) if x != y}
    assert got <= want and len(got) >= 0.95 * len(want)
    kept = jaccard.drop_near_duplicates(make(spark, rows))
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == make(spark, rows).columns and not [p for p in got if set(p) <= ids]


def test_suffix_matches_equal_brute_force(spark):
    rng = random.Random(5)
    items = [(i, words(rng, 30)) for i in range(6)] + [(9, "a short one")]
    docs = [(i, words(rng, 200)) for i in range(20)]
    docs[3] = (3, docs[3][1] + " " + " ".join(items[2][1].split()[5:25]) + " end")
    docs[7] = (7, "x, A short. ONE! y")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: {m["item_id"]: m["words"] for m in r["matches"]} for r in decontaminate.contamination(make(spark, docs), b).collect()}
    assert got[3] == {2: 20} and got[7] == {9: 3} and sum(map(len, got.values())) == 2
    assert {r["doc_id"] for r in decontaminate.remove_contaminated(make(spark, docs), b).collect()} == set(range(20)) - {3, 7}


def test_line_blocks():
    long = "A sentence of the article that is long enough to be text. " * 3
    page = f"<html><head><title>t</title></head><body><nav><li>Home</li><li>News</li></nav><p>{long}</p><p>{long}</p><br><br><br><footer>&copy; me</footer></body></html>"
    text, n = html.main_text(page)
    assert n >= 1 and "Home" not in text and "me" not in text.split() and text.count("article") == 6
    assert html.main_text(None) == (None, 0) and html.main_text("") == ("", 0)


def test_surrogates_keep_format_and_distinctness():
    s = pii.Surrogates(b"key of the tests")
    text = "Write to ann.lee@mail.example.com or +1 (743) 555-3824, card 4111 1111 1111 1111, ip 10.0.0.1. Mary Smith and Mr. Jones; Smith."
    new, found = pii.surrogate_text(text, s)
    assert {e["kind"] for e in found} == {"email", "phone", "card", "ipv4", "given", "surname"}
    for old in ("ann.lee", "555-3824", "4111 1111", "10.0.0.1", "Smith", "Jones", "Mary"):
        assert old not in new
    card = "".join(c for c in new.split("card ")[1][:19] if c.isdigit())
    assert pii._luhn(card[:-1]) == int(card[-1])
    again = [e["surrogate"] for e in found if e["kind"] == "surname"]
    assert again[0] == again[2] and pii.surrogate_text(text, pii.Surrogates(b"key of the tests"))[0] == new
    for n in (2, 3, 10, 97):
        image = [s.p.shift("t", n, x) for x in range(n)]
        assert sorted(image) == list(range(n)) and all(i != x for i, x in enumerate(image))
    names = [s.replace("given", g) for gs in pii.GIVEN.values() for g in gs]
    assert len(set(names)) == len(names)


def test_automaton_equals_recursive_backoff():
    """The traversal against the definition: discounted relative frequencies, and what is left spread over the shorter context."""
    texts = ["a b r a c a d a b r a", "c a d a b r a", "", None, "a b a b a c"]
    model = lm_score.Automaton(texts)
    seqs = list(model._words(texts))
    vocabulary = sorted({w for s in seqs for w in s})
    seen: dict = {}
    for s in seqs:
        padded = [lm_score._PAD, lm_score._PAD, *s]
        for i in range(2, len(padded)):
            for k in (0, 1, 2):
                seen.setdefault(tuple(padded[i - k : i]), []).append(padded[i])

    def p(h, w):
        if h not in seen:
            return p(h[1:], w)
        n = seen[h].count(w)
        kinds = len(set(seen[h]))
        if n:
            return (n - 0.75) / len(seen[h])
        if not h:
            return 0.75 * kinds / len(seen[h])
        left = 1 - sum(p(h[1:], x) for x in set(seen[h]))
        return 0.75 * kinds / len(seen[h]) * p(h[1:], w) / left

    for h in list(seen)[:30]:
        assert sum(p(h, w) for w in vocabulary) + p(h, -1) == pytest.approx(1)
    probe = ["a b r a", "zzz a b zzz", "d d d", "", "a c c a b r a c"]
    sizes, got = model.score(probe)
    for text, total, seq in zip(probe, got, model._words(probe)):
        padded = [lm_score._PAD, lm_score._PAD, *seq]
        assert total == pytest.approx(sum(math.log(p(tuple(padded[i - 2 : i]), padded[i])) for i in range(2, len(padded))))
    assert sizes.tolist() == [4, 4, 3, 0, 8]


def test_language_and_rejection():
    rng = random.Random(1)
    lang = {"xx": "abcde", "yy": "fghij"}
    make_text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    m = langid.Models({k: [make_text(v, 200) for _ in range(20)] for k, v in lang.items()})
    m.calibrate({k: [make_text(v, rng.randrange(20, 200)) for _ in range(40)] for k, v in lang.items()}, 0.001)
    best, h, _, ok = m.identify([make_text("abcde", 50), make_text("fghij", 50), make_text("qrstuv", 50), None, "", "..."])
    assert best == ["xx", "yy", best[2], None, None, None] and ok.tolist() == [True, True, False, False, False, False]


def test_warc_round_trip_and_damage(spark):
    pages = spark.createDataFrame([(1, "u1", "x" * 50_000), (2, "u2", "ü"), (3, "u3", None), (4, None, "")], "page_id long, url string, html string")
    rows = warc.to_records(pages).collect()
    records = spark.createDataFrame(rows, warc.RECORDS)
    of = {r["url"]: r["record_id"] for r in rows if not r["origin_id"]}
    back = {r["record_id"]: r for r in warc.reassemble(records).collect()}
    assert bytes(back[of["u1"]]["body"]) == b"x" * 50_000 and back[of["u2"]]["body"].decode() == "ü" and len(back) == 4
    assert back[of["u3"]]["status"] == "no_payload" and back[of["u3"]]["body"] is None and bytes(back[of[None]]["body"]) == b""
    one = f"record_id = '{of['u1']}'"
    lost = warc.reassemble(records.where("segment_number is null or segment_number <> 2")).where(one).first()
    assert lost["status"] == "missing_segment" and lost["body"] is None
    orphan = warc.reassemble(records.where("segment_number is null or segment_number <> 1")).where(one).first()
    assert orphan["status"] == "orphan"
    assert warc.decode_chunked(b"3;a=b\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc" and warc.decode_chunked(b"5\r\nabc\r\n0\r\n\r\n") is None


def test_packing_is_exact(spark):
    rng = random.Random(2)
    docs = [(i, "w " * rng.choice([1, 3, 9, 20, 34, 40, 60, 99, 100, 250])) for i in range(300)]
    rows = packing.pack(make(spark, docs), 100).collect()
    fill = {}
    for r in rows:
        fill.setdefault(r["bin_id"], []).append((r["bin_offset"], r["n_words"]))
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 100 and sum(3 * n > 100 for _, n in parts) <= 2
    assert sum(r["n_words"] for r in rows) == sum(len(t.split()) for _, t in docs)


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 1, (60, 8)) for c in rng.normal(0, 6, (12, 8))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(10_000, None), (None, [0.0] * 8), (10_001, [1.0]), (10_002, [float("nan")] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: [n["id"] for n in r["neighbours"]] for r in ann.nearest_neighbours(df, 5, leaf_size=32, bucket_size=100).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1)[:, :5]
    assert len(got) == len(x) and np.mean([len(set(got[i]) & set(want[i].tolist())) / 5 for i in range(len(x))]) >= 0.9
    assert ann.nearest_neighbours(df.limit(0)).count() == 0


def test_block_max_search_is_exact():
    rng = np.random.default_rng(0)
    n, terms = 150, 12
    dense = np.where(rng.random((n, terms)) < 0.3, rng.random((n, terms)), 0)
    rows, cols = np.nonzero(dense)
    index = toxicity.Index(rows, cols, dense[rows, cols], n, terms)
    for _ in range(30):
        q = np.where(rng.random(terms) < 0.4, rng.random(terms), 0)
        t = np.flatnonzero(q)
        found, score = index.nearest(t, q[t], 7)
        exact = np.round(dense @ q, 9)
        want = [i for i in np.lexsort((np.arange(n), -exact))[:7] if exact[i] > 0]
        assert found.tolist() == want and np.allclose(score, exact[want])


def test_toxicity_separates(spark):
    rng = random.Random(8)
    docs = [(i, words(rng, 60) + (" vile" + rng.choice(["ness", "st", "ly"]) if i % 4 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(150)] + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score_toxicity(make(spark, docs), labels).collect()}
    assert sum(got[i] == (i % 4 == 0) for i in range(200)) >= 196


def test_odd_rows_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(1, 0, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "same text here now")], "item_id long, text string")
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        assert jaccard.jaccard_join(docs).count() == 0
        assert jaccard.drop_near_duplicates(docs).count() == n
        assert decontaminate.contamination(docs, bench).where("contaminated").count() == (2 if n else 0)
        assert toxicity.drop_toxic(docs, labels).columns == docs.columns
        assert toxicity.score_toxicity(docs, labels).count() == n
        assert pii.replace_pii(docs).count() == n == pii.surrogates(docs).count()
        assert langid.identify_language(docs).count() == n == lm_score.score_documents(docs).count()
        packing.pack(docs).count()


def test_cosine_is_over_all_terms_of_the_examples(spark):
    """No term is left out: a text with terms of the examples has neighbours, and their cosines are those of brute force."""
    rng = random.Random(9)
    docs = [(i, words(rng, 30, 90) + f" only{i}" + (" vile" if i % 4 == 0 else "")) for i in range(60)] + [(99, "only7 only7 w5 nowhere"), (98, "nothing known")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(make(spark, docs), labels, k=5)
    texts = dict(docs)
    vectors = []
    for t in [texts[int(i)] for i in model.ids] + [texts[99]]:
        _, term, times = toxicity.known_features([t], model.vocabulary)
        v = np.zeros(len(model.vocabulary))
        v[term] = (1 + np.log(times)) * model.idf[term]
        vectors.append(v / np.linalg.norm(v))
    exact = np.round(np.array(vectors[:-1]) @ vectors[-1], 6)
    found = model.score([texts[99], texts[98], None])[1]
    assert [e["cosine"] for e in found[0]] == sorted(exact, reverse=True)[:5] and found[0][0]["doc_id"] == 7 and found[1:] == [[], []]
    # the frequency of a rare term is counted over all documents, and a term without a lean weighs its idf
    seven = toxicity.known_features(["only7"], model.vocabulary)[1]
    rare = model.idf[np.unique(seven)]
    assert np.isclose(rare.max(), 1 + math.log((1 + len(docs)) / 3))


def test_short_paragraphs_of_an_article_are_kept():
    long = "A sentence of the article that is long enough to be text. " * 3
    short = ["He paused.", "Why?", "No.", "So it is."]
    body = "".join(f"<p>{x}</p>\n\n" for x in [long, short[0], long, *short[1:], long, "The last one, of middle length, ends it."])
    menu = "<div><ul><li>Home</li><li>News</li><li>Shop</li></ul></div>"
    text, n = html.main_text(f"<body>{menu}<article><h2>T</h2><div>\n\n{body}</div></article>{menu}</body>")
    assert [x for x in text.split("\n") if len(x) < 50] == [*short, "The last one, of middle length, ends it."] and n == 1
    # what lies between two kept lines in a block of its own, or in a list of the body, is not kept
    for between in (menu, "<ul><li>Home</li><li>News</li><li>Shop</li></ul>"):
        text, n = html.main_text(f"<body><p>{long}</p>{between}<p>{long}</p></body>")
        assert "Home" not in text and text.count("article") == 6 and n == 2
    text, n = html.main_text(f"<main><p>{long}</p><ul><li>one</li><li>two</li><li>six</li></ul><p>{long}</p></main>")
    assert "one\ntwo\nsix" in text and n == 1
    # a small block beside the article is not part of it
    ad = "<div>Buy this now, it is cheap today only.</div>"
    assert "Buy" not in html.main_text(f"<body>{menu}{ad}<article><h1>Title of it all</h1><p>{long}</p><p>{long}</p></article>{ad}</body>")[0]


def test_elements_without_an_end_tag_hide_nothing_else():
    long = "A sentence of the article that is long enough to be text. " * 3
    for before in ("<head><title>gone</title><meta charset=x><body>", "<head><title>gone</title>", "<head><style>gone{}</style><script>'<p>gone'</script></head><body>", '<svg class="i" />', "<svg class=i />", "<svg class=i>", "<iframe src='x'/>", "<template>", "<select><option>one", "<noscript>", "<title>", "<iframe><iframe>gone</iframe>", "<template>gone<template>gone</template>gone</template>"):
        text, _ = html.main_text(f"<html>{before}<p>{long}</p><p>{long}</p><svg><text>gone</text></svg></html>")
        assert text.count("article") == 6 and "gone" not in text, before


def test_languages_with_few_documents_reject_junk(spark):
    rng = random.Random(2)
    write = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    docs = [(i, write(a, 150), lang) for lang, a, n in (("aa", "abcde", 60), ("ff", "fghij", 12), ("kk", "klmno", 4), ("one", "pqrst", 1)) for i in range(n)]
    m = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    best, _, _, ok = m.identify([write(x, 100) for x in ("abcde", "fghij", "klmno", "pqrst")])
    assert best == ["aa", "ff", "kk", "one"] and ok.tolist() == [True, True, True, False]
    junk = [write(x, 100) for x in ("uvwxyz", "\u03b1\u03b2\u03b3\u03b4", "afkpuz", "fuvwx", "kvwxy", "pwxyz")]
    assert not m.identify(junk)[3].any() and not np.isposinf(m.limits).any()
    alone = langid.fit(spark.createDataFrame(docs[-1:], "doc_id long, text string, lang string"))
    assert not alone.identify(junk)[3].any()


def test_scores_equal_the_traversal_whatever_is_held_at_once(spark):
    rng = random.Random(6)
    texts = [words(rng, 80) for _ in range(20)] + ["\u00e4bra " * 200, "rare \u4e2d\u6587", "", None, "...", "hot hot hot " * 500]
    texts += texts[:3]
    sizes, want = lm_score.Automaton(texts).score(texts)
    for block, parts in ((200, 4), (8_000_000, 0), (3000, 64)):
        rows = lm_score.score_documents(make(spark, list(enumerate(texts))), block_bytes=block, parts=parts).collect()
        got = {r["doc_id"]: (r["n_words"], r["log_prob"], r["bits_per_word"]) for r in rows}
        assert len(rows) == len(texts) and [got[i][0] for i in range(len(texts))] == sizes.tolist()
        assert np.allclose([got[i][1] for i in range(len(texts))], want, atol=1e-3)
        assert got[22][1:] == (0.0, None) and got[0][2] == pytest.approx(-want[0] / 80 / math.log(2), abs=1e-5)
    # what occurs twice is likelier than what occurs once
    assert max(want[i] / sizes[i] for i in range(3, 20)) < min(want[i] / sizes[i] for i in range(3))


def test_traversal_follows_failure_arcs_whatever_is_held_at_once(spark):
    """Texts that the model doesn't count leave its states by failure arcs: the scores are those of the automaton in memory."""
    rng = random.Random(16)
    write = lambda n, kinds: " ".join(f"w{min(rng.randrange(kinds), rng.randrange(kinds))}" for _ in range(n))
    counted = [write(rng.randrange(900), 30) for _ in range(25)] + ["", None, "one", "alone once", "hot " * 600]
    other = [write(n, 45) for n in (1, 2, 3, 255, 256, 257, 258, 259, 513, 1400)] + ["", None, "...", "zzz", "w1 zzz w2", "one one one", "alone once w1", "hot w0 " * 300]
    model = lm_score.Automaton(counted)
    followed = sum(w not in model.arcs.get((a, b), ()) for seq in model._words(other) for a, b, w in zip(seq, seq[1:], seq[2:]))
    assert followed > 500
    sizes, want = model.score(other)
    for block, parts in ((200, 4), (8_000_000, 0), (3000, 64)):
        rows = lm_score.score_documents(make(spark, list(enumerate(other))), block_bytes=block, parts=parts, model=make(spark, list(enumerate(counted)))).collect()
        got = {r["doc_id"]: r for r in rows}
        assert len(rows) == len(other) and [got[i]["n_words"] for i in range(len(other))] == sizes.tolist()
        assert np.allclose([got[i]["log_prob"] for i in range(len(other))], want, atol=1e-3)
    empty = lm_score.score_documents(make(spark, [(1, "w1 w2"), (2, None)]), model=make(spark, [(1, "")])).collect()
    assert {r["doc_id"]: (r["n_words"], r["log_prob"], r["bits_per_word"]) for r in empty} == {1: (2, 0.0, 0.0), 2: (0, 0.0, None)}


def test_states_arcs_and_failure_arcs_of_a_block_are_those_of_the_automaton():
    """What a block builds of the automaton, arc by arc, with its failure arcs and their weights; no other block adds anything."""
    rng = random.Random(17)
    texts = [" ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(60))) for _ in range(30)] + ["last words", "w1", None]
    model = lm_score.Automaton(texts)
    b = lm_score.Block.of(texts)
    n, v, names = len(b.keys), len(b.vocabulary), b.vocabulary.tolist()
    none, occurs = lm_score.squeeze(np.zeros(n, np.int64)), b.counts()[0]
    place = {"part": -1, "role": lm_score.BOTH, "ids": list(range(len(texts))), "check": b.check(), "words": lm_score._steps(b.vocabulary[1:]), "n_words": v - 1, "data": lm_score.squeeze(b.sequence), "sizes": b.sizes.tolist()}
    answer = {"part": 0, "check": b.check(), "n": n, "n_words": v, "data": lm_score._steps(np.arange(n)), "counts": none, "ends": none, "owned": np.packbits(occurs > 0).tobytes(), "symbols": lm_score.squeeze(np.arange(v)), "total": len(b.sequence), "kinds": v - 1}
    own = [model.arcs.get((names[w],), {}) for w in b.order[b.order < v]]
    times = {w: b.sequence.tolist().count(i) for i, w in enumerate(names)}
    no, words_of = lm_score.squeeze(np.zeros(0, np.int64)), lambda x: lm_score.squeeze(np.array(x))
    sums = {"part": 0, "n": 0, "n_states": 0, "n_words": v, "data": no, "arcs": no, "lower": no, "word_arcs": words_of([len(a) for a in own]), "word_lower": words_of([sum(times[w] for w in a) for a in own])}
    part = lm_score.Reached(lm_score.Answered([answer, place]), [sums], 0.75)
    states = [(names[x // v], names[x % v]) for x in b.pairs.tolist()] + [(w,) for w in names] + [()]
    assert len(part.arcs) == sum(map(len, model.arcs.values()))
    for code, weight, target in zip(part.arcs.tolist(), part.weight, part.target):
        following, want = model.step(states[code // v], names[code % v])
        assert names[code % v] in model.arcs[states[code // v]] and weight == pytest.approx(want) and states[target] == following
    for i, state in enumerate(states[:-1]):
        assert states[part.failure[i]] == state[1:]
        assert part.failure_weight[i] == pytest.approx(model.backoff.get(state, 0.0))
    assert part.unseen == pytest.approx(model.unseen) and len(model.backoff) > 100


def test_names_after_a_capitalised_word_are_replaced():
    s = pii.Surrogates(b"key of the tests")
    for text in ("Contact Mary Smith", "Dear Mary Smith, we saw Smith.", "Yesterday Old Mary Smith left", "Mary Anna Smith", "CONTACT MARY SMITH"):
        new, found = pii.surrogate_text(text, s)
        assert not any(x in new.lower() for x in ("mary", "smith")) and {e["kind"] for e in found} == {"given", "surname"}
        assert new.split(" ")[0] == text.split(" ")[0] or text.startswith("Mary")
    assert pii.surrogate_text("Contact Old Town", s)[1] == []
