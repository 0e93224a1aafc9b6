import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codecframe.llm import decontam, langid, mixing, queries

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def components(rows, k, percent):
    """Smallest identifier reachable, by brute force over all pairs."""
    sets, parent = {}, {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def deduped(rows):
    """Line dedup by its contract, in plain Python."""
    key = lambda line: re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    return {i: "\n".join(x for x in (text or "").split("\n") if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i) for i, text in rows}


def contaminated(text, items):
    """Whether a window of aligned tokens agrees, by brute force over all diagonals."""
    tokens = lambda t: re.sub(r"[\x00-\x7f]", lambda m: m.group().lower() if m.group().isalnum() else " ", t or "").split(" ")
    doc = [t for t in tokens(text) if t]
    for item in items:
        want = [t for t in tokens(item) if t]
        w = min(decontam.WINDOW, len(want))
        if not w or not set(want) & set(doc):
            continue
        for shift in range(w - len(want), len(doc) - w + 1):
            run = [0 <= shift + i < len(doc) and doc[shift + i] == want[i] for i in range(len(want))]
            at = sum(run[:w])
            for i in range(len(want) - w + 1):
                if i:
                    at += run[i + w - 1] - run[i - 1]
                if at >= decontam.AGREE * w and 0 <= shift + i and shift + i + w <= len(doc):
                    return True
    return False


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output, on the whole of a small table with odd rows added."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = random.Random(1)
    some = [x["text"] for x in docs.where("length(text) > 200").orderBy("doc_id").limit(3).collect()]
    rows = [(900_001, None, "en", "s", 0), (900_002, "", "en", None, 0), (900_003, some[0], "en", "s", 0), (900_004, some[1] + " more", None, None, 0), (900_005, " ".join(r.sample(some[2].split(), 40)), "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumns({"row": F.lit("kept"), "n_lines": F.lit("kept"), "score": F.lit("kept")})
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, SF)
        after = spark.createDataFrame(df.collect(), df.schema)
        out[name] = docs.collect(), after.collect(), docs.columns
        docs = after
    return out


def test_stages_match_brute_force(spark, stages):
    for name, (before, after, columns) in stages.items():
        assert len(after) and (name == "source_mix" or after[0].__fields__ == columns), name
        assert {r[c] for r in after for c in ("row", "n_lines", "score")} == {"kept"}
    before, after, _ = stages["language_id"]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert {900_001, 900_002} <= gone and len(gone) <= 2 + sum(not langid.has_letter(r["text"]) for r in before) + 0.02 * len(before)
    before, after, _ = stages["line_dedup"]
    assert {r["doc_id"]: r["text"] for r in after} == deduped([(r["doc_id"], r["text"]) for r in before])
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after, _ = stages["near_duplicates"]
    first = components([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, (_, c) in first.items() if c == i)
    before, after, _ = stages["decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if not contaminated(r["text"], items))
    before, after, _ = stages["source_mix"]
    for source in {r["source"] for r in after}:
        of = [r for r in after if r["source"] == source]
        assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= max(r["size"] for r in of) and all(0 < r["taken"] <= 2 * r["size"] for r in of)


def test_run_is_the_stages_in_order(spark):
    want = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, want, SF)
        want = spark.createDataFrame(df.collect(), df.schema)
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_queries_match_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    q = queries.queries()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in q["op9_ngram_jaccard"](spark, SF).collect()}
    assert got == components(list(docs.items()), 3, 90)
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]) for r in q["op1_decontaminate"](spark, SF).collect()}
    assert found == {(d, i) for d, t in docs.items() for i, x in items.items() if contaminated(t, [x])}
    told = q["op4_language_id"](spark, SF)
    right = told.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    assert told.columns == ["doc_id", "held_out", "lang_pred", "score"] and told.count() == len(docs)
    assert right.where("lang_pred = lang").count() >= 0.95 * right.count() > 0
    scored = q["op2_lattice_score"](spark, SF).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in scored} == {d: len(words(t)) + 1 for d, t in docs.items()}
    assert all(r["score"] < 0 and r["n_known"] <= r["n_tokens"] and (r["held_out"] or r["n_known"] == r["n_tokens"]) for r in scored)
    kept = q["op5_resample"](spark, SF).collect()
    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        a, b = labels.get(r["doc_id"], (1, 0))
        labels[r["doc_id"]] = min(a, r["quality"]), max(b, r["toxic"])
    assert len({r["doc_id"] for r in kept}) == len(kept) == round(len(docs) * sum(x == (1, 0) for x in labels.values()) / len(labels))
    turns = q["op8_chat_turns"](spark, SF)
    lines, right = turns.where("held_out").agg(F.sum("n_lines"), F.sum("lines_right")).first()
    assert right >= 0.85 * lines > 0 and not math.isnan(right)


def allocated(spark):
    """Bytes that the JVM's task threads have allocated."""
    threads = spark._jvm.java.lang.management.ManagementFactory.getThreadMXBean()
    ids = [t.getThreadId() for t in threads.getThreadInfo(threads.getAllThreadIds()) if t and t.getThreadName().startswith("Executor task")]
    return sum(map(threads.getThreadAllocatedBytes, ids))


def test_mix_counts_words_in_little_memory(spark, tmp_path):
    odd = [None, "", " ", " \t\n\x0b\x0c\r", "x", " x x x ", "a\x1cb c d", "é\U00020000 \n\n 一\x00 e\r", "  xx  x", "x" * 9, "a\x85b $1 \\ c"]
    got = spark.createDataFrame(list(enumerate(odd)), "i int, text string").select("i", mixing.word_count(F.col("text")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(odd)}
    texts = spark.range(200).select(F.repeat(F.concat(F.col("id").cast("string"), F.lit(" words in a row\n")), 5_000).alias("text"))
    texts.write.parquet(f"{tmp_path}/texts")
    texts = spark.read.parquet(f"{tmp_path}/texts")
    used = []
    for kind in (F.length("text").cast("long"), mixing.word_count(F.col("text"))):
        texts.agg(F.sum(kind)).first()  # compiled, and the threads there
        before = allocated(spark)
        size = texts.agg(F.sum(kind)).first()[0]
        used.append((allocated(spark) - before, size))
    assert used[1][1] == 200 * 5_000 * 5
    assert used[1][0] - used[0][0] < 40 * used[0][1]  # a word has four characters here


def test_mix_writes_few_tables(spark, monkeypatch):
    written = []
    monkeypatch.setattr(mixing.Scratch, "table", lambda self, df, name, table=mixing.Scratch.table: (written.append(name), table(self, df, name))[1])
    corpus_pipeline.source_mix(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()
    assert len(written) == 7, written


def test_stages_send_a_text_to_python_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in (corpus_pipeline.language_id, corpus_pipeline.decontamination):
        sent = re.findall(r"MapInArrow \w+\((.*?)\)", stage(spark, docs, SF)._jdf.queryExecution().analyzed().toString())
        assert sent and all(re.fullmatch(r"row#\d+", x) for x in sent), sent
