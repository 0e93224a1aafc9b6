import hashlib
import math
import random
import re
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codecframe.llm import chat, decontam, fingerprint, graph, jaccard, langid, lattice, linededup, mixing, resample, warc
from codecframe.llm import textscan as ts
from codecframe.llm.store import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(3)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(400)]


def prose(n, r=rng):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def _buffer(tokens):
    data = np.frombuffer(" ".join(tokens).encode(), np.uint8)
    return data, np.array([0, len(data)])


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    base = [prose(60, r) for _ in range(12)]
    near = [" ".join([*b.split()[:-1], "other"]) for b in base[:4]]
    texts = base + near + base[:3] + [None, "", "   ", "a b", "A b", "12 !!", "x" * 300_000, prose(20_000, r)]
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 4 else None, None) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def borderline(spark):
    """Texts just below the threshold of each other, which bitmaps take for linked, and links among them."""
    r = random.Random(8)
    base = prose(400, r).split()
    texts = [" ".join(base[:355] + prose(45, r).split()) for _ in range(12)]
    texts += [" ".join(t.split()[:-7] + prose(7, r).split()) for t in texts[:6]] + [" ".join(base[:330] + prose(70, r).split())]
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def clusters(spark):
    """Chains and clusters of near copies of several sizes, on shared passages."""
    r = random.Random(9)
    shared, rows = prose(30, r), []
    for size in (20, 60, 200, 700):
        for _ in range(3):
            base = prose(size, r).split()
            for edits in range(12):
                w = list(base)
                for _ in range(edits):
                    w[r.randrange(len(w))] = r.choice(VOCAB)
                rows.append(shared + " " + " ".join(w) if r.random() < 0.5 else " ".join(w))
                base = w if r.random() < 0.3 else base
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(rows)], DOCS)


PATHS = [("docs", {}), ("borderline", {}), ("clusters", {}), ("clusters", {"SMALL": 1}), ("clusters", {"SMALL": 1, "BLOCK_MOST": 3, "BLOCK_LEAST": 2}), ("clusters", {"HOT": 0, "HOT_RATIO": 0, "BLOCK_MOST": 5, "BLOCK_LEAST": 2}), ("borderline", {"SMALL": 1})]


@pytest.mark.parametrize("table, sizes", PATHS)
def test_jaccard_matches_brute_force(table, sizes, request, monkeypatch):
    for name, value in sizes.items():
        monkeypatch.setattr(jaccard, name, value)
    docs = request.getfixturevalue(table)
    rules = (3, 90), (5, 80)
    with ThreadPoolExecutor() as pool:  # small jobs wait for the driver more than they compute
        found = list(pool.map(lambda rule: jaccard.near_components(docs, *rule).collect(), rules))
    for (k, percent), rows in zip(rules, found, strict=True):
        sets, parent = {}, {}
        for r in docs.collect():
            w = words(r["text"])
            sets[r["doc_id"]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
            parent[r["doc_id"]] = r["doc_id"]

        def find(x, parent=parent):
            return x if parent[x] == x else find(parent[x])

        for a in sets:
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
        assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_bitmaps_bound_the_difference():
    r = np.random.default_rng(5)
    for n in (1, 3, 40, 300, 5000):
        a = r.integers(0, 1 << 63, n).astype(np.uint64)
        for gone in (0, 1, n // 20, n // 5):
            b = np.concatenate([a[gone:], r.integers(0, 1 << 63, 2 * gone).astype(np.uint64)])
            for percent in (80, 90):
                x, y = (jaccard.bitmap(s, percent, jaccard.TILE_BITS)[None] for s in (a, b))
                assert jaccard.differing(x, y)[0] <= 3 * gone and jaccard.differing(y, x)[0] <= 3 * gone


def test_near_duplicates_keeps_one_row_a_component(spark):
    import corpus_pipeline

    r = random.Random(12)
    a, b, c, d, e, f = (prose(60, r) for _ in range(6))
    near = lambda t: " ".join([*t.split()[:-1], "other"])
    rows = [(1, a), (1, a), (1, near(a)), (2, a)]  # a repeated row, and its identifier with a linked text
    rows += [(None, b), (None, b), (None, near(b))]  # no identifier at all
    rows += [(None, c), (3, c), (4, near(c))]  # a copy without identifier
    rows += [(None, d)]  # alone
    rows += [(5, e), (6, e), (6, f), (6, f)]  # one identifier in two components
    rows += [(7, ""), (7, ""), (None, None)]  # no words: each a component
    docs = spark.createDataFrame([(i, t, None, None, n) for n, (i, t) in enumerate(rows)], DOCS)
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    again = corpus_pipeline.near_duplicates(spark, docs.repartition(3, "n_chars"), "").collect()
    assert sorted(got, key=str) == sorted(again, key=str) and got[0].__fields__ == docs.columns
    kept = sorted(((x["doc_id"], x["text"]) for x in got), key=str)
    firsts = [x for x in kept if x[1] in (a, near(a))], [x for x in kept if x[1] in (b, near(b))]
    assert [len(x) for x in firsts] == [1, 1] and firsts[0][0][0] == 1 and firsts[1][0][0] is None
    assert [x for x in kept if x not in firsts[0] + firsts[1]] == sorted([(3, c), (None, d), (5, e), (6, f), (7, ""), (7, ""), (None, None)], key=str)


def test_decontam_finds_substituted_passages(spark, docs):
    item = prose(40)
    changed = item.split()
    changed[7] = changed[20] = "ZZZ"
    rows = [(100, prose(50) + " " + " ".join(changed) + ", " + prose(30), None, None, None), (101, item.upper(), None, None, None), (102, None, None, None, None)]
    all_ = docs.unionAll(spark.createDataFrame(rows, DOCS))
    tests = spark.createDataFrame([(1, item), (2, None), (3, "one two")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(all_, tests).collect()} == {(100, 1), (101, 1)}
    assert decontam.decontaminate(all_, tests).count() == all_.count() - 2
    assert decontam.overlaps(all_.limit(0), tests).count() == 0 == decontam.overlaps(all_, tests.limit(0)).count()


def test_decontam_reaches_every_accepted_substitution():
    r = random.Random(4)
    for n in range(5, 17):
        w = min(n, decontam.WINDOW)
        item = np.array([r.getrandbits(63) for _ in range(n)], np.uint64)
        index = decontam.Index([(1, item.view(np.int64).tolist())])
        for k in range(n - math.ceil(decontam.AGREE * w) + 1):
            for at in combinations(range(n), k):
                doc = np.array([r.getrandbits(63) for _ in range(n + 14)], np.uint64)
                doc[7 : 7 + n] = item
                doc[[7 + i for i in at]] += np.uint64(1)
                same = [i not in at for i in range(n)]
                want = max(sum(same[i : i + w]) for i in range(n - w + 1))
                got = index.search(doc)
                assert (got[1][0] if got else 0) == (want if want >= decontam.AGREE * w else 0), (n, at)
                assert index.hit(doc) == bool(got)


def test_decontam_finds_short_and_unspaced_items(spark):
    items = ["one two", "Solitaire!", "中文测试题目没有空格。", "ประเทศไทย", "東京タワーは高い", "𠀀𠀁𠀂", "!!", "a é ß q"]
    docs = ["say One, TWO now", "two one", "SOLITAIRE", "前面" + items[2] + "后面", "前中文测试题改没有空格后", "xx" + items[3] + "yy", "東京タワーは低い", "東京タワー", "z𠀀𠀁𠀂z", "𠀀𠀂", "?? !!", "A é ß Q.", "é ß q", "中文", None]
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1)
    want = {(0, 0), (2, 1), (3, 2), (4, 2), (5, 3), (6, 4), (8, 5), (11, 7)}
    assert {(x["doc_id"], x["item_id"]) for x in decontam.overlaps(table, tests).collect()} == want
    assert {x["doc_id"] for x in decontam.decontaminate(table, tests).collect()} == set(range(len(docs))) - {d for d, _ in want}


def spellings(p, word):
    """Log probability of a word, by enumeration of all segmentations."""
    text = lattice.WORD_START + word + lattice.WORD_END
    logp, total = dict(zip(p.texts, p.logp)), 0.0
    for cuts in product([0, 1], repeat=len(text) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
        prob = 1.0
        for a, b in zip(at, at[1:]):
            x = math.exp(logp[text[a:b]]) if text[a:b] in logp and (a == 0) == text[a:b].startswith(lattice.WORD_START) else 0.0
            if b == a + 1 and 0 < a < len(text) - 1:
                x += math.exp(sum(p.byte_logp[c] for c in text[a].encode()))
            prob *= x
        total += prob
    return math.log(total)


@pytest.fixture
def pieces():
    start = lattice.WORD_START
    few = {start: 0.5, start + "a": 0.5, "a": 0.2, "ab": 0.15, "aab": 0.05, "b": 0.2, "é": 0.1, lattice.WORD_END: 0.2}
    return lattice.Pieces({k: math.log(v) for k, v in few.items()}, [math.log(0.1 / 256)] * 256)


WORDS = ["aab", "b", "aabaabab", "éa", "x", "a" + lattice.WORD_START + "a", "abéü𠀀b", "aaaaaaaaa", "aab", ""]


@pytest.mark.parametrize("cells", [lattice.CELLS, 8])
def test_lattice_sums_all_segmentations(pieces, monkeypatch, cells):
    monkeypatch.setattr(lattice, "CELLS", cells)
    got = pieces.marginals(pa.array(WORDS))
    assert got == pytest.approx([spellings(pieces, w) for w in WORDS])
    # expected uses are the derivatives of the log marginals
    uses, spelt = pieces.expected(pa.array(WORDS))
    for k in range(len(pieces.texts)):
        moved = lattice.Pieces(dict(zip(pieces.texts, pieces.logp + 1e-6 * (np.arange(len(pieces.texts)) == k))), pieces.byte_logp)
        assert uses[k] == pytest.approx((moved.marginals(pa.array(WORDS)) - got).sum() / 1e-6, abs=1e-4)
    moved = lattice.Pieces(dict(zip(pieces.texts, pieces.logp)), pieces.byte_logp + 1e-6)
    assert spelt.sum() == pytest.approx((moved.marginals(pa.array(WORDS)) - got).sum() / 1e-6, abs=1e-4)
    again = pieces.refit(uses, spelt)
    assert again.marginals(pa.array(WORDS)).sum() > got.sum()
    assert np.exp(again.logp[again.opens]).sum() == pytest.approx(1)
    assert np.exp(again.logp[~again.opens]).sum() + np.exp(again.byte_logp).sum() == pytest.approx(1)


def test_lattice_takes_a_very_long_word(pieces):
    word = "ab" * 60_000
    half = spellings(pieces, "ab" * 5), spellings(pieces, "ab" * 6)
    assert pieces.marginal(word) == pytest.approx(half[0] + (half[1] - half[0]) * (60_000 - 5), rel=1e-3)


@pytest.mark.parametrize("learn, frequent", [("doc_id % 3 <> 0", 20), ("false", lattice.FREQUENT), ("true", lattice.FREQUENT)])
def test_lattice_scores_match_brute_force(docs, monkeypatch, frequent, learn):
    monkeypatch.setattr(lattice, "FREQUENT", frequent)
    model = "/opt/tokenizers/piece_bpe_32k.model"
    table = docs.select("doc_id", "text").withColumn("learn", F.expr(learn))
    out = {r["doc_id"]: r for r in lattice.score(table, F.col("learn"), model, steps=1).collect()}
    rows, count, ends = table.collect(), {}, 0
    for r in rows:
        ends += r["learn"]
        for w in words(r["text"]) if r["learn"] else ():
            count[w] = count.get(w, 0) + 1
    n, v, total = sum(count.values()) + ends, len(count) + (ends > 0), sum(count.values())
    pieces = lattice.load_pieces(model)
    if count:
        pieces = pieces.refit(*pieces.expected(pa.array(list(count))))
    known = sorted(set().union(*[words(r["text"]) for r in rows]))
    sub = dict(zip(known, pieces.marginals(pa.array(known))))
    off = lattice.discounts([list(count.values()).count(k) for k in (1, 2, 3, 4)])
    of = lambda c: off[min(c, 3) - 1]
    freed = sum(of(c) for c in count.values()) / total if total else 1.0

    def log_p(w):
        c = count.get(w, 0)
        return math.log10(((c - of(c)) / total if c else 0.0) + freed * math.exp(sub[w])) + math.log10((total + 1) / (n + 2))

    assert sum(10 ** log_p(w) for w in count) + 10 ** math.log10((ends + 1) / (n + 2)) <= 1 + 1e-9
    for r in rows:
        w, got = words(r["text"]), out[r["doc_id"]]
        base = sum(math.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert (got["n_tokens"], got["n_known"], got["train_tokens"]) == (len(w) + 1, sum(x in count for x in w) + (ends > 0), n)
        assert got["base_score"] == pytest.approx(base)
        if all(len(x) < 1000 for x in w):
            assert got["score"] == pytest.approx(sum(map(log_p, w)) + math.log10((ends + 1) / (n + 2)))


def test_fingerprints_follow_the_contract(docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.orderBy("doc_id").collect()]
    got = {r["doc_id"]: r for r in fingerprint.compare_neighbours(docs).collect()}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(text)
        assert got[i]["fingerprint"] == fingerprint.to_string(fingerprint.chunk_weights(text))
    moved = fingerprint.chunk_weights("inserted " + rows[-1][1])
    assert fingerprint.likeness(moved, fingerprint.chunk_weights(rows[-1][1])) > 0.95
    assert fingerprint.compare_neighbours(docs.limit(0)).count() == 0


def test_language_id(spark):
    r = random.Random(1)
    make = lambda alphabet: " ".join("".join(r.choice(alphabet) for _ in range(5)) for _ in range(30))
    rows = [(i, make("abcdefg" if i % 2 else "nopqrst"), "x" if i % 2 else "y") for i in range(80)] + [(80, None, "x"), (81, "12 !", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in langid.identify(df, langid.fit(df.where("doc_id < 60"))).collect()}
    assert all(out[i]["lang_pred"] == rows[i][2] for i in range(80)) and out[80]["lang_pred"] == out[81]["lang_pred"] == "und"
    assert langid.identify(df, langid.fit(df.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_language_id_samples_distinct_texts(spark, monkeypatch):
    sizes = []
    train = langid.train_ftrl
    monkeypatch.setattr(langid, "train_ftrl", lambda rows, classes: sizes.append([y for *_, y in rows]) or train(rows, classes))
    r = random.Random(2)
    texts = [prose(12, r) for _ in range(60)]
    for copied in texts[:4]:
        rows = [(t, "x") for t in texts] + [(copied, "x")] * 3000 + [(t.upper() + " q", "y") for t in texts]
        langid.fit(spark.createDataFrame(rows, "text string, lang string"), per_language=1000)
        langid.fit(spark.createDataFrame(rows, "text string, lang string"), per_language=30)
    for whole, part in zip(sizes[::2], sizes[1::2], strict=True):
        assert len(whole) == 96 and all(12 <= part.count(y) <= 36 for y in (0, 1))


def test_language_id_drops_no_label(spark):
    df = spark.createDataFrame([(c * 9, c) for c in "abcd"] + [("d" * 8, "d")], "text string, lang string")
    assert langid.fit(df, most_languages=4).languages == list("abcd")
    with pytest.raises(ValueError, match="more than 3 languages"):
        langid.fit(df, most_languages=3)


def test_resample_matches_brute_force(spark, docs):
    df = docs.select("doc_id", "text")
    wanted = spark.createDataFrame([(i,) for i in (0, 1, 2, 2, 3, 5, 999, None)], "id long")
    chosen = resample.rows_of(df, wanted)
    assert sorted(r["doc_id"] for r in chosen.collect()) == [0, 1, 2, 3, 5]
    raw, target, texts = np.zeros(resample.BUCKETS), np.zeros(resample.BUCKETS), {}
    for r in df.collect():
        w = words(re.sub(r"[\x00-\x7f]", lambda m: m.group() if m.group().isalnum() else " ", r["text"] or ""))
        one = [int(h) for h in ts.word_hashes(*_buffer(w))[0]]
        two = [int(ts.mix(np.array([(a * 3 + b) % 2**64], np.uint64))[0]) for a, b in zip(one, one[1:])]
        texts[r["doc_id"]] = [h >> (64 - resample.BUCKET_BITS) for h in one + two]
        for t in (raw, target) if r["doc_id"] in (0, 1, 2, 3, 5) else (raw,):
            np.add.at(t, texts[r["doc_id"]], 1)
    ratio = resample.fit(df, chosen)
    scale = target.sum() / raw.sum()
    assert np.allclose(ratio, [math.log((a + resample.PRIOR) / (b * scale + resample.PRIOR)) for a, b in zip(target, raw)])
    full = {r["doc_id"]: r for r in resample.resample(df, ratio, 999).collect()}
    assert len(full) == df.count()
    for i, r in full.items():
        assert r["log_weight"] == pytest.approx(sum(ratio[b] for b in texts[i]), abs=1e-9)
    for k in (1, 9, 20):
        best = sorted(full, key=lambda i: -full[i]["gumbel_key"])[:k]
        assert {r["doc_id"] for r in resample.resample(df, ratio, k, keep=["doc_id"]).collect()} == set(best)
    assert resample.resample(df.limit(0), ratio, 3).count() == 0 == resample.resample(df, np.zeros(resample.BUCKETS), 0).count()


def test_resample_keys_order_all_doubles(spark):
    ratio = np.zeros(resample.BUCKETS)
    rows = [(i, "w " * n) for i, n in enumerate((0, 1, 10, 1000, 50_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for value in (1e6, -1e6):  # weights far beyond any fixed range
        keys = {r["doc_id"]: r["gumbel_key"] for r in resample.resample(df, ratio + value, 9).collect()}
        for k in range(1, 5):
            best = sorted(keys, key=lambda i: -keys[i])[:k]
            assert sorted(r["doc_id"] for r in resample.resample(df, ratio + value, k).collect()) == sorted(best)


def test_warc_round_trip(spark):
    big = "é" * 1_500_000
    rows = [(3, "u\r\nv", "p" * 100), (1, None, "p" * 100), (2, "w", "small"), (4, "w", "small"), (5, "w", None), (6, "w", big), (None, "w", "p" * 100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.archive_and_read(df).collect()}
    assert all(r["whole"] for r in got.values()) and len(got) == len(rows)
    assert {i for i, r in got.items() if r["record_type"] == "revisit"} == {3, None} and got[3]["refers_to"] == 1
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_chat_segments_agree_with_one_chain(spark, monkeypatch):
    roles = ["system", *["user", "assistant"] * 6]
    rows = [(c, t, roles[t], prose(8) + ("?" if roles[t] == "user" else ".\n" + prose(5))) for c in range(30) for t in range(13)] + [(99, 0, "user", None), (None, None, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumn("text", chat.mark(F.col("conv_id"), F.coalesce("turn", F.lit(0)), F.col("role"), F.col("text")))
    model = chat.fit(df)
    whole = {(r["conv_id"], r["turn"]): r for r in chat.parse(df, model).collect()}
    monkeypatch.setattr(chat, "SEGMENT", 3)
    cut = {(r["conv_id"], r["turn"]): r for r in chat.parse(df, model).collect()}
    assert {k: r["turns"] for k, r in whole.items()} == {k: r["turns"] for k, r in cut.items()}
    assert sum(r["turns"][0]["role"] == r["role"] for r in whole.values()) >= 0.97 * len(rows)


def test_chat_finds_turns_in_pieces_cut_anywhere(spark, monkeypatch):
    r = random.Random(6)
    roles = ["system", *["user", "assistant"] * 6]
    rows = [(c, t, roles[t], "\n".join(prose(6, r) for _ in range(r.randint(1, 5)))) for c in range(40) for t in range(13)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = turns.withColumn("text", F.concat(F.initcap("role"), F.lit(": "), "text"))
    lines, want = {}, {}
    for x in turns.orderBy("conv_id", "turn").collect():
        for i, line in enumerate(x["text"].split("\n")):
            lines.setdefault(x["conv_id"], []).append(line)
            want.setdefault(x["conv_id"], []).append(2 * chat.ROLES.index(x["role"]) + (i > 0))
    monkeypatch.setattr(chat, "SEGMENT", 4)
    pieces = chat.transcripts(turns)
    got = {}
    for x in pieces.orderBy("conv_id", "piece").collect():
        assert len(x["truth"]) == x["text"].count("\n") + 1 <= chat.LINES
        got.setdefault(x["conv_id"], []).append(x)
    assert {c: "\n".join(x["text"] for x in xs) for c, xs in got.items()} == {c: "\n".join(x) for c, x in lines.items()}
    assert {c: sum((x["truth"] for x in xs), []) for c, xs in got.items()} == want
    assert any(x["truth"][0] % 2 for xs in got.values() for x in xs)
    model = chat.fit(turns)
    found = {}
    for x in chat.parse(pieces, model, turn="piece").orderBy("conv_id", "piece").collect():
        assert [t["line"] for t in x["turns"]] == [sum(t["n_lines"] for t in x["turns"][:i]) for i in range(len(x["turns"]))]
        for t in x["turns"]:
            s = 2 * chat.ROLES.index(t["role"])
            found.setdefault(x["conv_id"], []).extend([s + (not t["opens"]), *[s + 1] * (t["n_lines"] - 1)])
    assert found == want


def test_line_dedup_and_mix(spark):
    rows = [(1, "Shared line here\nown one is long"), (2, " shared LINE here \nshort\nshort"), (3, None), (4, "")]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["kept_text"], got[2]["kept_text"], got[2]["n_dropped"], got[3]["n_lines"]) == (rows[0][1], "short\nshort", 1, 1)
    df = spark.createDataFrame([(i, "w " * (i % 7), None if i % 3 == 0 else "ab"[i % 2]) for i in range(300)], "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    for s in {r["source"] for r in out}:
        of = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= 6 and all(r["taken"] <= 2 * r["size"] for r in of)
    assert mixing.mix(df.limit(0)).count() == 0


#: Names that operators use for themselves, or once did, and some that need quoting.
CLASHES = """prefix rest rounds plan_source mix_key mix_size drop_pos d_doc ln_doc ln_row k b s lm_words dsir_hash dsir_key chat_row conv seg
row id hash order part extra h first words known base page bits match at learn place owner pos line item tokens node label n star hub u v""".split() + ["a b", "x`y", "a.b", "ä"]
KEEP = {
    "decontaminate": lambda d: decontam.decontaminate(d, d.sparkSession.createDataFrame([(1, "no such passage anywhere at all")], "item_id long, text string")),
    "score": lambda d: lattice.score(d, F.col("doc_id") > 1, "/opt/tokenizers/piece_bpe_32k.model", steps=1),
    "identify": lambda d: langid.identify(d, langid.fit(d)),
    "resample": lambda d: resample.resample(d, np.zeros(resample.BUCKETS), 10**6),
    "dedup_lines": linededup.dedup_lines,
    "parse": lambda d: chat.parse(d, chat.fit(d.withColumn("role", F.lit("user")), conv="source", turn="doc_id"), conv="source", turn="doc_id"),
    "mix": mixing.mix,
}
DROP = {
    "overlaps": lambda d: decontam.overlaps(d, d.where("text is not null").limit(1), item_id="doc_id"),
    "compare_neighbours": fingerprint.compare_neighbours,
    "archive_and_read": lambda d: warc.archive_and_read(d, "doc_id", "source", "text"),
    "near_components": jaccard.near_components,
}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and blank texts, repeated rows, equal texts, clashing columns."""
    line = "a line that is long enough"
    rows = [(1, line, "en", "s"), (1, line, "en", "s"), (2, line, "en", None), (None, line, None, "s"), (None, None, None, None), (None, None, None, None)]
    rows += [(3, "", "fr", "s"), (4, " \n\t", "fr", ""), (5, "user: hi\nassistant: ho", None, "s"), (5, "other text of this one", "en", "s"), (6, "w " * 30_000, "en", "t")]
    df = spark.createDataFrame([(*r, i // 2) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"of {c}").alias(c) for c in CLASHES])


@pytest.mark.parametrize("name", sorted(KEEP))
def test_rows_are_kept_with_all_their_columns(odd, name):
    plain = lambda d: sorted(str([r[c] for c in odd.columns]) for r in d.collect())
    out = KEEP[name](odd)
    assert plain(out.select(*[F.col("`" + c.replace("`", "``") + "`") for c in odd.columns])) == plain(odd)
    assert KEEP[name](odd.limit(0)).count() == 0
    again = KEEP[name](odd.repartition(3))
    more = [c for c in out.columns if c not in odd.columns]
    values = lambda d: sorted(str((r["doc_id"], r["text"], [round(r[c], 6) if isinstance(r[c], float) else r[c] for c in more])) for r in d.collect())
    if name != "parse":  # rows that tie have no order
        assert values(out) == values(again)


@pytest.mark.parametrize("name", sorted(DROP))
def test_odd_rows_have_results(odd, name):
    out = DROP[name](odd).collect()
    if name != "overlaps":
        key = "page_id" if name == "archive_and_read" else "doc_id"
        assert sorted(str(r[key]) for r in out) == sorted(str(r["doc_id"]) for r in odd.collect())
    assert DROP[name](odd.limit(0)).count() == 0
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    assert sorted(map(str, DROP[name](plain).collect())) == sorted(map(str, out))


def test_fingerprints_and_chunks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_A_PART", 3)
    r = random.Random(11)
    rows = [(i * 7 % 40 if i % 9 else None, prose(r.randint(0, 90), r) if i % 5 else "é𠀀" * i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in (None, "text"):
        table = df if name is None else df.withColumn("doc_id", F.concat(F.lit("d"), F.coalesce("doc_id", F.lit(-1))))
        h = {(x["doc_id"], x["text"]): x["h"] for x in table.withColumn("h", F.xxhash64("text")).collect()}
        order = sorted(h, key=lambda k: (k[0] is not None, k[0] or 0, h[k]) if name is None else (k[0], h[k]))

        def weights(text):
            data, out, last = text.encode(), {}, 0
            for end in range(1, len(data) + 1):
                gear = sum(int(fingerprint._gear[data[end - 1 - age]]) << age for age in range(min(32, end))) % 2**32
                n = end - last
                cut = n >= fingerprint.LEAST and not gear & int(fingerprint.STRICT if n < fingerprint.NORMAL else fingerprint.LOOSE)
                if cut or n == fingerprint.MOST or end == len(data):
                    d = int(ts.span_hashes(np.frombuffer(data, np.uint8), np.array([last]), np.array([end]))[0]) >> 24
                    out[d] = out.get(d, 0) + n
                    last = end
            return out

        def like(a, b):
            share = lambda x, y: sum(min(n, y.get(k, 0)) for k, n in x.items()) / sum(x.values()) if x else 1.0
            return min(share(a, b), share(b, a))

        want = []
        for k, (i, text) in enumerate(order):
            after = order[(k + 1) % len(order)][1]
            q = len(text) // 4
            edited = text[: len(text) - q] + after[:q]
            fp, efp = weights(text), weights(edited)
            want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.to_string(fp), fingerprint.to_string(efp), like(fp, efp), like(fp, weights(after))))
        assert sorted(map(str, map(tuple, fingerprint.compare_neighbours(table).collect()))) == sorted(map(str, want))


def test_warc_escapes_identifiers(spark):
    rows = [("a\r\nX-Page: b", "u", "p" * 100), ("ü % + ", "u", "p" * 100), ("", "u", "p"), (None, "u", "q")]
    out = warc.archive_and_read(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert sorted(str(r["page_id"]) for r in out) == sorted(str(r[0]) for r in rows) and all(r["whole"] for r in out)
    assert {r["refers_to"] for r in out} == {None, "a\r\nX-Page: b"}


def test_tables_left_behind(spark, docs):
    left = Scratch(spark, "test")
    before = len(left.paths)
    jaccard.near_components(docs).count()
    t = left.table(docs.select("doc_id"), "t")
    left.keep(t)
    assert len(left.paths) == before + 1
    left.drop(t)
    assert left.paths == []


@pytest.mark.parametrize("few, tables", [(graph.FEW, 2), (100, None), (0, None)])
def test_components_of_small_graphs_take_few_tables(spark, monkeypatch, few, tables):
    r = random.Random(5)
    name = [r.randrange(-(1 << 63), 1 << 63) for _ in range(400)]
    edges = [(name[i], name[i + 1]) for i in range(150)]  # a chain
    edges += [(name[200], name[i]) for i in range(201, 300)]  # a star
    edges += [(name[i], name[j]) for i, j in (r.sample(range(300, 400), 2) for _ in range(60))]
    edges += [(v, u) for u, v in edges[::3]] + edges[::5] + [(name[199], name[199])]
    want = {x: x for e in edges for x in e if e[0] != e[1]}
    for u, v in edges:
        if u != v and want[u] != want[v]:
            a, b = want[u], want[v]
            want = {x: a if y == b else y for x, y in want.items()}
    monkeypatch.setattr(graph, "FEW", few)
    written, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: written.append(name) or table(self, df, name))
    got = graph.components(spark.createDataFrame(edges, "u long, v long").repartition(3), scratch := Scratch(spark, "test"))
    got = {x["node"]: x["label"] for x in got.collect()}
    groups = lambda of: {frozenset(x for x in of if of[x] == y) for y in of.values()}
    assert groups(got) == groups(want)
    assert tables is None or len(written) <= tables, written
    assert graph.components(spark.createDataFrame([], "u long, v long"), scratch).collect() == []
    scratch.keep()
