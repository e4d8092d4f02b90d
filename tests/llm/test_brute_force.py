"""The operators that SQL doesn't express against plain versions of themselves, and their behaviour on odd input."""

import gzip
import math
import random
import time

import numpy as np
import pytest

from tessera.llm import ann, decontaminate, html, jaccard, kneser_ney, langid, packing, pii, queries, toxicity, warc
from tessera.llm.textops import words as word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, gone_id long, one long, bucket long"
KEY = b"a key of 32 bytes or so for tests"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3) for i, t in rows], DOCS)


def prose(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def near_copies(rng, count, most=12):
    texts = []
    for _ in range(count):
        base = prose(rng, 60).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 4)):
            copy = list(base)
            for _ in range(rng.randrange(0, most)):
                copy[rng.randrange(60)] = f"x{rng.randrange(50)}"
            texts.append(" ".join(copy))
    return texts


def brute_classes(rows):
    """(class, links, copies) of each doc_id by comparing all pairs."""
    sets = {i: grams(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}
    links = {i: set() for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
                if sets[i] != sets[j]:
                    links[i].add(frozenset(sets[j]))
                    links[j].add(frozenset(sets[i]))
    copies = {i: sum(sets[j] == sets[i] for j in sets) - 1 if sets[i] else 0 for i in sets}
    return {i: (root[i], len(links[i]), copies[i]) for i in sets}


@pytest.mark.parametrize("options", [{}, {"spark_bucket": 8, "brute_force": 6, "depth": 2}])
def test_classes_equal_brute_force(spark, options):
    rng = random.Random(11)
    texts = near_copies(rng, 14) + [None, "", "...", "two words", "two words"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard.jaccard_classes(make(spark, [*rows, (None, "no id"), rows[0]]), target_recall=0.99, **options).collect()}
    assert got.pop(None) == (None, 0, 0)
    want = brute_classes(rows)
    assert got.keys() == want.keys() and sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_a_large_group_of_near_copies_is_compared_in_blocks(spark):
    """Tokens can't divide near copies: every pair is found all the same, and no task holds the whole group."""
    rng = random.Random(12)
    base = prose(rng, 200, 10_000).split()
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(60)]
    pairs = jaccard.jaccard_join(make(spark, rows), spark_bucket=10, brute_force=5, depth=1)
    assert pairs.count() == 60 * 59 // 2
    got = jaccard.jaccard_classes(make(spark, rows), spark_bucket=10, brute_force=5, depth=2).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 59)}


def brute_matches(text, items, least):
    a, out = (text or "").split(), {}
    for k, item in items:
        b = (item or "").split()
        need, best = min(least, len(b)), None
        for x in range(len(a) if b else 0):
            for y in range(len(b) - need + 1):
                n = 0
                while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                    n += 1
                if n >= need and (best is None or n > best[0]):
                    best = n, x
        if best:
            out[k] = best
    return out


def test_suffix_matches_equal_all_substrings():
    rng = random.Random(1)
    for _ in range(25):
        docs = [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(5)]
        items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))) for i in range(4)]
        least = rng.choice([3, 5])
        # pieces shorter than the test texts: matches that cross their ends are whole
        for most in (12, 100, 1 << 19):
            passes = [(np.array([i]), *word_hashes([t])) for i, t in items]
            got = decontaminate.match_texts(docs, passes, least, most)
            assert [{k: (m["words"], m["doc_word"]) for k, m in x.items()} for x in got] == [brute_matches(d, items, least) for d in docs]


def test_a_test_text_longer_than_a_piece_ends(spark):
    long = [f"v{i}" for i in range(60)]
    passes = [(np.array([7]), *word_hashes([" ".join(long)]))]
    got = decontaminate.match_texts([" ".join(["x", *long, "y"])], passes, 5, 12)
    assert got == [{7: {"item_id": 7, "words": 60, "doc_word": 1, "item_word": 0}}]
    with pytest.raises(ValueError):
        list(decontaminate._pieces(np.array([0, 100]), 20, 10))
    docs = make(spark, [(1, "a b c d e f"), (2, None), (None, "c d e f"), (2, "q r s t")])
    bench = spark.createDataFrame([(1, "c d e f g"), (2, "q r s t"), (3, None), (None, "a b c d")], "item_id long, text string")
    rows = decontaminate.contamination(docs, bench, 4, max_benchmark_words=4).collect()
    assert sorted((r["doc_id"] or -1, [m["item_id"] for m in r["matches"]]) for r in rows) == [(-1, [1]), (1, [-1, 1]), (2, []), (2, [2])]


def naive_parts(lengths, window, surge, dive):
    sums = [sum(lengths[i : i + window]) for i in range(max(1, len(lengths) - window + 1))] if len(lengths) else []
    out, i = [], 0
    while i < len(sums):
        if sums[i] < surge:
            i += 1
            continue
        end = i
        while end < len(sums) and sums[end] >= dive:
            end += 1
        end = end if end < len(sums) else len(lengths)
        a, b = i, end
        while a < b and lengths[a] < surge / window:
            a += 1
        while b > a and lengths[b - 1] < surge / window:
            b -= 1
        if a < b:
            out.append((a, b))
        i = end + 1
    return out


def test_parts_equal_a_naive_scan():
    rng = random.Random(4)
    for _ in range(300):
        lengths = np.array([rng.choice([0, 3, 10, 27, 40, 90]) for _ in range(rng.randrange(0, 30))], np.int64)
        assert html.parts(lengths, 3, 80, 50) == naive_parts(lengths.tolist(), 3, 80, 50)


def test_pages_of_every_kind(spark):
    long = "A sentence of the article that is long enough to be text. " * 3
    rows = [(1, "u", f"<p>{long}</p>", 0), (1, "u", f"<p>{long}</p>", 0), (2, None, None, 0), (None, "v", "", 0), (3, "w", "<p>short</p>", 0), (4, "x", f"<p>{'long ' * 200_000}</p>", 0), (5, "y", "<" * 50_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = html.extract_pages(pages)
    assert got.columns == ["page_id", "url", "text", "n_parts"]
    by = {r["page_id"]: (r["text"], r["n_parts"]) for r in got.collect()}
    assert by[1] == (long.strip(), 1) and by[2] == (None, 0) and by[None] == ("", 0) and by[3] == ("", 0) and len(by[4][0]) == 999_999
    assert got.count() == len(rows) and html.extract_pages(pages.limit(0)).count() == 0


def test_surrogates_depend_on_the_key_and_collide_nowhere(spark):
    rng = random.Random(7)
    one, two = pii.Surrogates(KEY), pii.Surrogates(b"another key")
    kinds = {
        "email": [f"{prose(rng, 1)}.{i}@mail{i % 7}.example.com" for i in range(400)],
        "ipv4": [f"10.{i % 7}.{i}.{i * 3 % 256}" for i in range(256)],
        "phone": [f"+1 ({200 + i}) 555-{1000 + i}" for i in range(400)],
        "secret": [f"{rng.getrandbits(160):040x}" for _ in range(300)],
        "surname": sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(400)}),
    }
    for kind, values in kinds.items():
        image = [one.replace(kind, v) for v in values]
        assert len(set(image)) == len(set(values)) and not any(a == b for a, b in zip(image, values)), kind
        # who has another key neither repeats nor undoes the surrogates
        assert sum(two.replace(kind, v) == x for v, x in zip(values, image)) <= 2, kind
    docs = make(spark, [(1, "Write to ann@mail.example.com"), (2, None), (3, "")])
    spark.conf.unset(pii.KEY_SETTING)
    first = [r["text"] for r in pii.replace_pii(docs).orderBy("doc_id").collect()]
    key = spark.conf.get(pii.KEY_SETTING)
    assert len(key) == 64 and [r["text"] for r in pii.replace_pii(docs).orderBy("doc_id").collect()] == first and first[1:] == [None, ""]
    spark.conf.unset(pii.KEY_SETTING)
    assert [r["text"] for r in pii.replace_pii(docs).orderBy("doc_id").collect()] != first
    spark.conf.unset(pii.KEY_SETTING)


@pytest.mark.parametrize("text", ["a" * 1_000_000, "中" * 1_000_000, "a@" * 300_000, "A-" * 400_000, "1-" * 400_000, "a." * 400_000 + "@x", "+1" * 300_000, "Mary N " * 100_000])
def test_detection_is_linear(text):
    begin = time.process_time()
    pii.surrogate_text(text, pii.Surrogates(KEY))
    assert time.process_time() - begin < 20


def test_persons_by_cue_and_cards_by_check_digit():
    s = pii.Surrogates(KEY)
    new, found = pii.surrogate_text("My name is Zorblat Quux. Regards,\nZorblat; Quux's desk. Name: Vexa", s)
    assert not any(x in new for x in ("Zorblat", "Quux", "Vexa")) and {e["kind"] for e in found} == {"surname"} and "'s desk" in new
    assert pii.surrogate_text("order 1234567812345678 and 9807915762804490", s)[1] == []
    new, found = pii.surrogate_text("card 4111111111111111", s)
    assert [e["kind"] for e in found] == ["card"] and pii._is_card(new.split()[1]) and new != "card 4111111111111111"


def test_language_models_equal_recursive_kneser_ney():
    rng = random.Random(3)
    texts = {k: ["".join(rng.choice(v) for _ in range(60)) for _ in range(4)] for k, v in {"aa": "abc ", "bb": "bcd "}.items()}
    m = langid.Models(texts)
    key, _ = langid.letters(["abcd bad cab", "dddd"])
    got = m.log_probabilities(key)
    mask = (1 << langid.BITS) - 1
    for j, language in enumerate(m.languages):
        own = kneser_ney.estimate(*np.unique(langid.letters(texts[language])[0], return_counts=True), langid.N, langid.BITS, m.size)

        def logp(gram, k):
            """By the definition: what an order has seen, or its back-off weight and the order below."""
            if k < 0:
                return -math.log(m.size)
            o = own[k]
            known = dict(zip(o.keys.tolist(), o.logp))
            if gram & ((1 << langid.BITS * (k + 1)) - 1) in known:
                return known[gram & ((1 << langid.BITS * (k + 1)) - 1)]
            weight = dict(zip(o.contexts.tolist(), o.backoff)).get((gram & ((1 << langid.BITS * (k + 1)) - 1)) >> langid.BITS, 0.0)
            return weight + logp(gram, k - 1)

        assert np.allclose(got[:, j], [logp(int(x), langid.N - 1) for x in key])
    # vowel signs are letters of their words
    hindi = langid.letters(["नमस्ते"])[0]
    assert not ((hindi & mask) == 32).any()


def test_records_of_any_pages_come_back(spark, tmp_path):
    long = "".join(chr(97 + i % 26) for i in range(30_000))
    rows = [(3, "u", "a"), (3, "u", "a"), (3, "v", long), (3, "v", long), (2, None, None), (None, "w", "x"), (None, "w", None), (-4, "k", "\r\n\r\nWARC/1.1\r\n\r\n"), (5, "e", "")]
    pages = spark.createDataFrame([(*r, 1, b"p") for r in rows], "page_id long, url string, html string, record_id int, payload binary")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op6_warc_reassembly(spark, str(tmp_path)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    want = [(i, u, "no_payload" if h is None else "ok", None if h is None else len(h.encode()), h) for i, u, h in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert warc.reassemble(warc.to_records(pages.limit(0))).count() == 0
    records = [tuple(r) for r in warc.to_records(pages).collect()]
    data = warc.write_warc(records)
    for name, content in (("a.warc", b"noise\n" + data), ("b.warc.gz", b"".join(gzip.compress(warc.write_warc([r])) for r in records))):
        (tmp_path / name).write_bytes(content)
        back = [tuple(r) for r in warc.read_warc(spark, f"{tmp_path}/{name}").collect()]
        assert sorted(back, key=key) == sorted(records, key=key)
    # records of a segment that came twice count once; an unsegmented record that came twice has two rows
    twice = spark.createDataFrame(records * 2, warc.RECORDS)
    assert warc.reassemble(twice).count() == 2 * sum(r[2] is None for r in records) + sum(r[2] == 1 for r in records)


def naive_bins(lengths, capacity):
    """Large items matched greedily, small ones best fit, piece by piece."""
    pieces = [p for n in lengths for p in [capacity] * (n // capacity) + ([n % capacity] if n % capacity else [])]
    large = sorted(p for p in pieces if 3 * p > capacity)
    gaps = []
    while large:
        a = large.pop()
        fit = [i for i, b in enumerate(large) if a + b <= capacity]
        gaps.append(capacity - a - (large.pop(fit[-1]) if fit else 0))
    for p in sorted((p for p in pieces if 3 * p <= capacity), reverse=True):
        at = [i for i, g in enumerate(gaps) if g >= p]
        if at:
            gaps[min(at, key=lambda i: gaps[i])] -= p
        else:
            gaps.append(capacity - p)
    return len(gaps)


def test_packing_equals_naive_packing(spark):
    rng = random.Random(5)
    for capacity in (10, 100, 31):
        for _ in range(20):
            lengths = [rng.randrange(1, 2 * capacity) for _ in range(rng.randrange(1, 60))]
            pieces = [p for n in lengths for p in [capacity] * (n // capacity) + ([n % capacity] if n % capacity else [])]
            assert packing.plan({n: pieces.count(n) for n in set(pieces)}, capacity)[1] == naive_bins(lengths, capacity)
    docs = make(spark, [(i % 50 if i % 7 else None, "w " * rng.choice([0, 5, 5, 5, 40, 250])) for i in range(300)] + [(1, None)])
    lengths = [len(r["text"].split()) for r in docs.where("text is not null").collect()]
    for rank_rows in (1, 7, 100_000):  # ranks in one bucket or many
        rows = packing.pack(docs, 100, rank_rows=rank_rows).collect()
        places = sorted((r["bin_id"], r["bin_offset"], r["n_words"]) for r in rows)
        assert sum(n for *_, n in places) == sum(lengths) and len({b for b, *_ in places}) == naive_bins([n for n in lengths if n], 100)
        assert all(x[0] != y[0] or x[1] + x[2] <= y[1] for x, y in zip(places, places[1:])) and all(o + n <= 100 for _, o, n in places)
    assert packing.pack(docs.limit(0)).count() == 0


def test_neighbours_of_a_query_set_with_ties_and_a_hot_leaf(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([np.tile(rng.normal(0, 1, 6), (150, 1)), rng.normal(0, 4, (300, 6))]).round(3)
    rows = [(i, v.tolist(), 0, True, 1) for i, v in enumerate(x)] + [(440, x[3].tolist(), 0, True, 1), (None, x[0].tolist(), 0, True, 1), (9000, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, True, 1), (9001, [], 0, True, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, bucket int, is_query boolean, q int")
    asked = table.where("vec_id % 50 = 0")
    got = {r["vec_id"]: [(n["id"], n["distance"]) for n in r["neighbours"]] for r in ann.nearest_neighbours(table, 5, asked, leaf_size=16, bucket_size=40, target_recall=0.99).collect()}
    assert got.keys() == {i for i in range(450) if i % 50 == 0}
    hits = 0
    for i, near in got.items():
        d = np.sqrt(((np.append(x, x[3:4], 0) - x[i]) ** 2).sum(1)).round(6)
        ids = np.append(np.arange(len(x)), 440)
        keep = ids != i
        best = np.lexsort((ids[keep], d[keep]))[:5]
        want = list(zip(ids[keep][best].tolist(), d[keep][best].tolist()))
        hits += sum(a <= b for (_, a), (_, b) in zip(near, want)) / len(want)  # recall, ties by distance
        if i in (0, 50, 100):  # among equal vectors ties go by id
            assert near == want
    assert hits >= 0.9 * len(got)
    assert ann.nearest_neighbours(table.limit(0), queries=asked).count() == 0 and ann.nearest_neighbours(table, queries=asked.limit(0)).count() == 0


def test_examples_are_bounded_by_rows(spark):
    rng = random.Random(2)
    docs = make(spark, [(i % 2, prose(rng, 20) + (" vile" if i % 2 else "")) for i in range(200)])
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    assert len(toxicity.fit(docs, labels, max_examples=5).ids) == 2


def test_pairs_of_a_large_bucket_are_verified_batch_by_batch(spark):
    """No task holds a bucket's pairs: they come in more than one batch and block, and all are found with their similarities."""
    rng = random.Random(13)
    base = prose(rng, 60, 10_000).split()
    texts = [" ".join([*base[: 30 + rng.randrange(30)], f"end{i}"]) for i in range(70)] + ["a lone text", "two words"]
    sets = [{tuple(t.split()[i : i + 3]) for i in range(max(1, len(t.split()) - 2))} for t in texts]
    docs = make(spark, list(enumerate(texts)))
    signed = jaccard.signatures(docs, 3, 2).selectExpr("set_key", "doc_id as one", "grams")
    key = {r["one"]: r["set_key"] for r in signed.collect()}
    by = {v: k for k, v in key.items()}
    rows = [(min(key[i], key[j]), max(key[i], key[j]), 5, 1, 0, 0) for i in range(70) for j in range(i)] + [(*sorted((key[70], key[71])), 6, 1, 0, 0)]
    pairs = spark.createDataFrame(rows, "a long, b long, bucket long, heads int, once int, twice int")
    want = {frozenset((i, j)): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(70) for j in range(i)}
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for blocks in ({}, {"block_grams": 600}, {"block_pairs": 100}):
            got = jaccard._verify(pairs, signed, docs, 3, 0.5, **blocks).collect()
            found = {frozenset((by[r["a"]], by[r["b"]])): r["jaccard"] for r in got}
            assert len(found) == len(got) and found == pytest.approx({k: v for k, v in want.items() if v >= 0.5})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    ends = jaccard._blocked(pairs, pairs.selectExpr("bucket", "explode(array(a, b)) as set_key", "20 as grams").distinct(), 600, 10**6)[0]
    assert ends.count() == len(rows) and ends.groupBy("bucket").count().agg({"count": "max"}).first()[0] < 70 * 69 // 4


@pytest.mark.parametrize("brute_force", [40, 10_000])
def test_a_bucket_gives_a_pair_once(brute_force):
    """A pair that shares the tokens of several branches came once for each leaf."""
    rng = np.random.default_rng(14)
    tokens = np.tile(rng.integers(0, 65536, jaccard.TOKENS), (150, 1)).astype(np.uint16)
    other = rng.random(tokens.shape) < 0.1
    tokens[other] = rng.integers(0, 65536, other.sum())
    found = [frozenset(p) for i, j in jaccard._bucket_pairs(tokens, 1, 4, brute_force, 0.3, 1, 2) for p in zip(i.tolist(), j.tolist())]

    def together(rows, level):
        if len(rows) <= brute_force or level == 4:
            return {frozenset((i, j)) for i in rows for j in rows if i < j and (tokens[i] == tokens[j]).mean() >= 0.3}
        parts = [[i for i in rows if tokens[i, c] == v] for c in (jaccard._column(1, level, b) for b in (0, 1)) for v in set(tokens[rows, c].tolist())]
        return set().union(*(together(x, level + 1) for x in parts if len(x) > 1))

    assert len(found) == len(set(found)) and set(found) == together(list(range(150)), 1)
