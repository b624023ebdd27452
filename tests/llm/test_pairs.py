"""Near duplicates, repeated passages and benchmark leaks against brute force."""

import contextlib
import hashlib
import io
import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geotrail.llm import components, decontamination, fmindex, jaccard_join, queries, substring_dedup
from geotrail.llm.docfilter import document_filter, may_matter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(None, "no id at all but words"), (900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "one"), (903, "one"), (905, "two words"), (None, None)]


def corpus(seed, copies=14, extra=()):
    """Texts with exact copies, near copies, a shared line amid other words, and odd rows."""
    rng = random.Random(seed)
    vocab = [f"w{k}é" for k in range(300)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, line = [], text(16)
    for _ in range(12):
        rows.append(text(rng.randint(3, 60)))
    base = text(70)
    for _ in range(copies):
        near = list(base)
        for _ in range(rng.randint(0, 3)):
            near[rng.randrange(len(near))] = rng.choice(vocab)
        rows.append(near)
    rows += [list(rows[3]) for _ in range(3)]
    for _ in range(6):
        rows.append(text(rng.randint(0, 9)) + line + text(rng.randint(0, 9)))
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(k, rng.choice([" ", "\n", "  "]).join(rows[i])) for k, i in enumerate(order)] + ODD + list(extra)


def shingles(text, k):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def classes_by_brute_force(rows, k=5, threshold=0.8):
    sets = [shingles(t, k) for _, t in rows]
    similar = [
        [j for j, b in enumerate(sets) if j != i and rows[i][0] is not None and rows[j][0] is not None and a and b and len(a & b) >= threshold * len(a | b)]
        for i, a in enumerate(sets)
    ]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(similar):
            least = min([root[i], *(root[j] for j in near)], key=lambda r: (rows[r][0] is None, rows[r][0] or 0))
            if rows[least][0] != rows[root[i]][0]:
                root[i], changed = least, True
    return sorted(((i, rows[root[n]][0], len(similar[n])) for n, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize(("small", "block"), [(64, 512), (2, 3)])
def test_classes_and_links(spark, small, block):
    rows = corpus(small)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, class_id int")
    got = jaccard_join.join_similar(docs, small=small, block=block)
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()), key=str) == classes_by_brute_force(rows)


@pytest.mark.parametrize("parts", [1, 16])
def test_bucket_of_several_runs_counts_in_the_first(spark, monkeypatch, parts):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(words[:12] + [f"v{k}" for k in range(40)]))]
    crowds = {0: (10, (1, 2)), 1: (20, (1, 2, 3)), 2: (10, (1, 2))}
    found = [(s, run, bucket, len(members), 60 * len(members)) for run, (bucket, members) in reversed(crowds.items()) for s in members]
    buckets = spark.createDataFrame(found, "set_id long, run int, bucket long, n long, total long").repartition(parts, "run")
    buckets = buckets.sortWithinPartitions(F.desc("run"))
    monkeypatch.setattr(jaccard_join, "_buckets", lambda *_: buckets)
    got = jaccard_join.join_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()), key=str) == classes_by_brute_force(rows)


def test_classes_of_nothing(spark):
    assert jaccard_join.join_similar(spark.createDataFrame([], "doc_id string, text string")).collect() == []


def test_runs_reach_the_recall():
    for depth in (1, 2, 3):
        runs = jaccard_join.runs_for(depth, 0.8, 0.9999)
        assert (1 - 0.8**depth) ** runs <= 1e-4 < (1 - 0.8**depth) ** (runs - 1)


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (1, 50, 5000, 7000, 3, 900)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert jaccard_join.overlaps(sets, sets).tolist() == want
    assert jaccard_join.overlaps(sets[:2], sets[2:4]).tolist() == [row[2:4] for row in want[:2]]


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: root[x] for e in edges if e[0] != e[1] for x in e}


def repeats_by_brute_force(rows, window):
    where = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (i, _), own in zip(rows, words, strict=True):
        for k in range(len(own) - window + 1) if i is not None else []:
            gram = tuple(own[k : k + window])
            where[gram] = min(where.get(gram, i), i)
    out = []
    for (i, _), own in zip(rows, words, strict=True):
        gone = [False] * len(own)
        for k in range(len(own) - window + 1) if i is not None else []:
            if where[tuple(own[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(w for w, g in zip(own, gone, strict=True) if not g)
        out.append((i, len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize(("window", "gram", "crowd"), [(13, 5, 2000), (6, 3, 1), (4, 4, 2000)])
def test_repeats(spark, monkeypatch, window, gram, crowd):
    rows = corpus(window, extra=[(950, "a b " * 40), (951, "b a " * 40), (951, "b a " * 40)])
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_words string")
    every = substring_dedup.find_repeats
    monkeypatch.setattr(substring_dedup, "find_repeats", lambda d, w, g: every(d, w, g, crowd))
    got = substring_dedup.remove_repeats(docs, window=window, gram=gram).collect()
    want = repeats_by_brute_force(rows, window)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == sorted((w[:4] for w in want), key=str)
    texts = sorted((str(r["doc_id"]), " ".join(WORD.findall(r["kept_text"] or ""))) for r in got)
    assert texts == sorted((str(w[0]), w[4]) for w in want)


def test_texts_go_to_tasks_once_and_in_bounded_batches(spark, monkeypatch):
    held = lambda: [spark.conf.get(f"spark.sql.{k}") for k in ("execution.arrow.maxBytesPerBatch", "classic.shuffleDependency.fileCleanup.enabled")]
    before, seen, every = held(), [], substring_dedup.find_repeats
    monkeypatch.setattr(substring_dedup, "find_repeats", lambda d, w, g: seen.append(held()) or every(d, w, g))
    rows = corpus(1) + [(2000 + k, f"{k} " * 12 + "word " * 400) for k in range(600)]
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, lang string").coalesce(1)
    got = substring_dedup.remove_repeats(docs)
    assert got.columns == ["text", "doc_id", "lang", "n_words", "n_removed", "kept_text", "kept_sha256"]
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        got.explain()
    carried = re.findall(r"struct\((.*?)\) AS kept", plan.getvalue())
    assert len(carried) == 2 and all("lang" in c and "text" not in c for c in carried)
    assert seen == [[str(4 << 20), "true"]] and held() == before
    kept = {w[0]: w[4] for w in repeats_by_brute_force(rows, 13)}
    texts = dict(rows)
    for r in got.where("doc_id >= 0 AND doc_id NOT IN (903)").collect():
        assert r["text"] == texts[r["doc_id"]] and r["lang"] == "x"
        assert r["n_removed"] and WORD.findall(r["kept_text"]) == kept[r["doc_id"]].split(" ")[: r["n_words"] - r["n_removed"]] or r["kept_text"] == r["text"]


def test_cut_texts_leave_a_task_in_slices():
    import pyarrow as pa

    texts = [f"{k} " * 500 for k in range(3000)] + [None, ""]
    spans = [[{"place": 0, "mask": 1}] if k % 2 else None for k in range(3000)] + [None, None]
    batch = pa.RecordBatch.from_pylist([{"kept": {"doc_id": k}, "text": t, "spans": s} for k, (t, s) in enumerate(zip(texts, spans, strict=True))])
    out = list(substring_dedup.cut_slices(iter([batch]), 13))
    assert len(out) > 10 and max(b.num_rows for b in out) < 300
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["kept"]["doc_id"] for r in rows] == list(range(3002)) and [r["text"] for r in rows] == texts
    assert [r["kept_text"] for r in rows[:2]] == [None, " 1" * 487 + " "] and all((r["kept_text"] is None) == (s is None) for r, s in zip(rows, spans, strict=True))


def test_a_text_of_another_type_stays_as_it_is(spark):
    line = " ".join(f"w{k}" for k in range(20)).encode()
    docs = spark.createDataFrame([(1, line), (2, line + b" end"), (3, None)], "doc_id int, text binary")
    got = sorted(tuple(r) for r in substring_dedup.remove_repeats(docs).drop("kept_sha256").collect())
    assert got[:2] == [(1, line, 20, 0, line.decode()), (2, line + b" end", 21, 20, " end")] and got[2] == (3, None, 0, 0, None)
    assert substring_dedup.remove_repeats(docs).schema["text"].dataType.simpleString() == "binary"


def test_repeats_of_nothing(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_index_counts_patterns():
    rng = np.random.default_rng(4)
    text = rng.integers(1, 4, 500)
    text[::50] = 0
    index = fmindex.FMIndex(text, 4, 8)
    ends = np.array([e for e in range(8, 500) if (text[e - 7 : e + 1] > 0).all()])
    for threshold in (1, 3, 8):
        length, low, high = index.matches(text, ends, threshold)
        for e, n, a, b in zip(ends, length, low, high, strict=True):
            own = text[e - n + 1 : e + 1]
            found = sum((text[i : i + n] == own).all() for i in range(500 - n + 1))
            assert found == b - a and (n == threshold or found == 1)


def test_edges_of_a_task_are_kept():
    import pyarrow as pa

    table = pd.DataFrame({"gram": [1, 2, 2, 3, 3, 3, 4, 5], "doc_id": [9, 1, 1, 1, 1, 2, 5, 5], "place": range(8), "content": 0})
    for size in (1, 2, 3, 8):
        batches = pa.Table.from_pandas(table).to_batches(max_chunksize=size)
        kept = [p for b in substring_dedup._shared_only(iter(batches)) for p in b.column(2).to_pylist()]
        assert kept == [0, 3, 4, 5, 7]


def test_filter_rules_out_no_wanted_document(spark):
    docs = spark.range(2000).withColumnRenamed("id", "doc_id")
    wanted = docs.where("doc_id % 7 = 0")
    kept = {r[0] for r in may_matter(docs, document_filter(wanted)).collect()}
    assert kept >= {r[0] for r in wanted.collect()} and len(kept) < 400


def test_leaks(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [" ".join(word() for _ in range(n)) for n in (30, 30, 45, 17, 3)]
    near = items[0].split()
    near[1] = "changed"
    far = items[0].split()
    far[14] = far[15] = far[25] = "changed"
    filler = lambda n: " ".join(word() for _ in range(n))
    docs = [
        (0, filler(80)),
        (1, filler(40) + " " + items[0].upper() + "! " + filler(20)),
        (2, items[2] + ", " + items[1]),
        (3, filler(9) + " " + " ".join(near)),
        (4, " ".join(far)),
        (5, "é — " + items[4] + "."),
        (6, " ".join(items[3].split()[:16])),
        (7, None),
        (8, ""),
        (1, items[0]),
        (None, items[1] + " " + items[1]),
    ]
    benchmark = spark.createDataFrame(list(enumerate(items)) + [(7, None), (8, ""), (0, items[0])], "item_id int, text string")
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, leaks string")
    for part_chars in (10**6, 100):
        found = decontamination.find_leaks(table, benchmark, part_chars=part_chars).collect()
        assert len(found) == len(docs)
        got = sorted((str(r["doc_id"]), x["item_id"]) for r in found for x in {x["item_id"]: x for x in r["leaks"]}.values())
        assert got == sorted([("1", 0), ("2", 2), ("2", 1), ("3", 0), ("5", 4), ("6", 3), ("1", 0), ("None", 1)])
        by_text = {r["doc_id"]: r for r in found if r["doc_id"] in (2, 5)}
        for doc_id, item in ((2, 1), (5, 4)):
            leak = next(x for x in by_text[doc_id]["leaks"] if x["item_id"] == item)
            assert by_text[doc_id]["text"][leak["char_start"] : leak["char_end"]] == items[item] and leak["similarity"] == pytest.approx(1)
    assert decontamination.find_leaks(table.limit(0), benchmark).collect() == []
    assert all(r["leaks"] == [] for r in decontamination.find_leaks(table, benchmark.limit(0)).collect())


def weighted_windows(docs, items, k=5, least=0.8):
    """Every document and item with a window at or above the similarity, by trying all windows."""
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    grams = lambda w: {tuple(w[a : a + min(k, len(w))]) for a in range(len(w) - min(k, len(w)) + 1)}
    with_it = Counter(g for _, t in items for g in grams(words(t)))
    rare, out = math.log1p(len(items)), set()
    for item, text in items:
        own, n = grams(words(text)), len(words(text))
        weight = {g: math.log1p(len(items) / with_it[g]) for g in own}
        size = min(k, n)
        for doc, t in docs if n else []:
            all_words = words(t)
            span = min(n, len(all_words))
            for a in range(len(all_words) - span + 1 if span >= size else 0):
                here = {tuple(all_words[a + b : a + b + size]) for b in range(span - size + 1)}
                both = sum(weight[g] for g in sorted(here & own))
                if both / (sum(weight.values()) + rare * len(here - own)) >= least:
                    out.add((doc, item))
                    break
    return out


def test_parts_of_the_benchmark_decide_nothing(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    head = [word() for _ in range(14)]
    items = [(k, " ".join(head + [word() for _ in range(rng.choice((6, 10, 26)))])) for k in range(40)]
    docs = []
    for k in range(520):
        own = rng.choice(items)[1].split()
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            own[rng.randrange(len(own))] = word()
        docs.append((k, " ".join([word() for _ in range(rng.randrange(9))] + own + [word() for _ in range(rng.randrange(9))])))
    table, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    found = []
    for part_chars in (10**6, 2500, 600):
        leaks = decontamination.find_leaks(table, benchmark, keep=["doc_id"], part_chars=part_chars).selectExpr("doc_id", "inline(leaks)").collect()
        found.append(sorted(tuple(r) for r in leaks))
    assert found[0] == found[1] == found[2]
    want, got = weighted_windows(docs, items), {(r[0], r[1]) for r in found[0]}
    assert got <= want and len(want - got) <= 0.001 * len(want) and 100 < len(want) < 510


def test_all_fingerprints_within_the_radius_are_candidates():
    rng = np.random.default_rng(2)
    near = decontamination.FLIPS[np.arange(256)[:, None] ^ np.arange(256)] <= decontamination.RADIUS // decontamination.BLOCKS
    for _ in range(500):
        a = rng.integers(0, 256, 8)
        flips = np.zeros(64, np.uint8)
        flips[rng.choice(64, decontamination.RADIUS, replace=False)] = 1
        b = a ^ np.packbits(flips)
        assert near[a, b].any()


def test_registered_queries(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op8_substring_dedup(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(w[:4] for w in repeats_by_brute_force(docs, 13))
    got = queries.op3_jaccard_join(spark, sf_dir).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == classes_by_brute_force(docs)
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    want = {(d, i) for d, t in docs for i, x in items if plain(x) in plain(t)}
    found = queries.op9_decontamination(spark, sf_dir).collect()
    assert want <= {(r["doc_id"], r["item_id"]) for r in found} and all(r["similarity"] >= 0.8 for r in found)
