"""The pipeline's stages and run() against plain versions, on rows with nulls, copies and columns of clashing names."""

import hashlib
import random
import re

import pytest

import corpus_pipeline as pipeline
from tests.llm.test_operators import components_of
from tracewright.llm import crf

KINDS = {"aa": ["the", "thing", "with", "running", "that", "house", "water", "street"], "bb": ["ción", "mente", "los", "que", "ñas", "casa", "agua", "calle"]}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, stays boolean, row string, doc_key map<string,int>"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(60):
        lang = ("aa", "bb")[i % 2]
        out.append((i, " ".join(rng.choice(KINDS[lang]) + str(rng.randrange(40)) for _ in range(rng.randint(30, 60))), lang, f"s{i % 3}"))
    for i in range(8):  # near copies, exact copies
        words = out[i][1].split()
        words[3] = "changed"
        out += [(100 + i, " ".join(words), out[i][2], "s1"), (200 + i, out[i][1], out[i][2], None)]
    item = "what is the capital of the largest country in the middle of the map"
    out += [(300, f"{out[20][1]} {item} {out[21][1]}", "aa", "s0"), (301, None, "aa", "s0"), (302, "", None, "s0"), (303, "123 456", "bb", "s2"), (5, out[5][1], "bb", "s2"), (None, out[9][1] + " more", None, None)]
    return [(*r, len(r[1] or ""), 0.5, "zz", True, "r", {"a": 1}) for r in out], item


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows[0], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, rows[1]), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def kept(docs):
    return sorted(((r.doc_id, r.text, r.source) for r in docs.collect()), key=str)


def test_language_id_drops_what_has_no_language(spark, rows, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = pipeline.language_id(spark, docs, folder)
    assert out.columns == docs.columns
    found = {r.doc_id: (r.lang_pred, r.score) for r in crf.predict(docs.select("doc_id", "text"), crf.train(docs), ["doc_id"]).collect()}
    plain = [r for r in rows[0] if found[r[0]][0] != "und" and found[r[0]][1] >= pipeline.LEAST_SCORE]
    assert kept(out) == sorted(((r[0], r[1], r[3]) for r in plain), key=str)
    assert not {301, 302, 303} & {r[0] for r in plain} and len(plain) >= len(rows[0]) - 6


def test_one_of_each_group_stays(spark, rows, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = pipeline.near_duplicates(spark, docs, folder)
    assert out.columns == docs.columns
    got = [r[:2] for r in kept(out)]
    numbered = [(i, r[1]) for i, r in enumerate(rows[0])]
    groups = {}
    for (i, text), (_, size, component) in zip(numbered, components_of(numbered, 5, 80)):
        groups.setdefault(component if size else ("wordless", i), []).append(i)
    firsts = [min(g, key=lambda i: (rows[0][i][0] is not None, rows[0][i][0] or 0)) for g in groups.values()]
    assert [(i, t) for i, t in got] == sorted(((rows[0][i][0], rows[0][i][1]) for i in firsts), key=str)


def test_documents_with_test_items_go(spark, rows, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert kept(pipeline.decontamination(spark, docs, folder)) == sorted(((r[0], r[1], r[3]) for r in rows[0] if rows[1] not in (r[1] or "")), key=str)


def filled(budget, children):
    """Shares of a budget by weight, none above its capacity. children: node, weight, capacity."""
    out, open_ = {}, list(children)
    while True:
        total = sum(w for _, w, _ in open_)
        full = [c for c in open_ if c[2] * total <= budget * c[1]]
        if not full:
            return out | {n: min(budget * w // total, c) for n, w, c in open_}
        out |= {n: c for n, _, c in full}
        budget -= sum(c for _, _, c in full)
        open_ = [c for c in open_ if c not in full]
        if not open_:
            return out


def test_mixing_takes_prefixes_of_leaves(spark, rows, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").dropDuplicates(["doc_id", "text"])
    data, tokens = [r for r in docs.collect()], {}
    leaf = lambda r: ("d" + str(int(hashlib.md5((r.source or "(null)").encode()).hexdigest()[:2], 16) % 4), r.lang or "(null)", r.source or "(null)")
    count = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    for r in data:
        tokens[leaf(r)] = tokens.get(leaf(r), 0) + count(r)
    weights = [pipeline.budget.WEIGHTS.get(level, {}) for level in pipeline.budget.LEVELS]
    budgets = {(): int(sum(tokens.values()) * pipeline.SHARE)}
    for k in range(3):
        nodes = {n[: k + 1] for n in tokens}
        for parent in {n[:k] for n in nodes}:
            family = [(n, weights[k].get(n[k], 1), sum(t for x, t in tokens.items() if x[: k + 1] == n)) for n in nodes if n[:k] == parent]
            budgets |= filled(budgets[parent], family)
    out = pipeline.mixing(spark, docs, folder)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got.setdefault(leaf(r), []).append(count(r))
    for n, t in tokens.items():
        if budgets[n] >= t:
            assert sum(got.get(n, [])) == t
        elif budgets[n]:
            # Whole documents, the last of which crosses the budget.
            assert budgets[n] <= sum(got[n]) < budgets[n] + max(got[n])
        else:
            assert n not in got


def test_run_is_its_stages_one_after_the_other(spark, rows, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
    want = sorted((r.doc_id is not None, r.doc_id) for r in docs.collect())
    got = pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id is not None, r.doc_id) for r in got) == want
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    counts = [len(sizes.get(k, [])) for k in range(pipeline.SHARDS)]
    assert max(counts) - min(counts) <= 1


def test_empty_tables_give_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
