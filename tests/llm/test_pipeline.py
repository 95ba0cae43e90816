"""The pipeline, stage by stage, against cases planted in a small corpus."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rng = random.Random(1)
    texts = {i: words(rng, 120) for i in range(60)}
    texts[60] = texts[5].replace(" ", "  ", 3)  # exact copy
    w = texts[7].split()
    texts[61] = " ".join([*w[:60], "different", *w[61:]])  # near copy
    passage = words(rng, 55)
    texts[62], texts[63] = words(rng, 50) + " " + passage, words(rng, 70) + " " + passage + " " + words(rng, 9)
    labels = []
    for i in range(70, 150):
        toxic = i % 2 == 0
        texts[i] = words(rng, 40) + (" qzvyxqzv " if toxic else " ") + words(rng, 20)
        labels.append((i, 1, int(toxic)))
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), texts


def test_stages(spark, planted):
    folder, texts = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in seen[name].items()], docs.schema)
    clean = {i for i in texts if i < 70 or i % 2}
    assert set(seen["toxicity"]) == clean
    assert set(seen["exact_dedup"]) == clean - {60}
    assert set(seen["simhash_near_dedup"]) == clean - {60, 61}
    last = seen["substring_dedup"]
    assert last[62] == texts[62]
    assert len(last[63].split()) == len(texts[63].split()) - 55
    assert all(last[i] == texts[i] for i in last if i != 63)


def test_run(spark):
    assert entry.queries()["pipeline"](spark, SF).count()


@pytest.mark.parametrize("n", range(1, 11))
def test_one_query_per_operator(n):
    assert len([q for q in entry.queries() if q.startswith(f"op{n}_")]) == 1


CLASHING = "_id _sha0 _sha _tag _kept_text _n_words _n_removed own row_key place copy b blob k uid".split()


def odd_rows(rng):
    """Nulls, empty and long texts, ties and rows that repeat."""
    long = words(rng, 30_000)
    rows = [(1, None), (2, ""), (3, "  "), (None, None), (None, words(rng, 40)), (4, long), (5, long), (6, "x"), (6, "y"), (6, "y")]
    return rows + [(7, words(rng, 50))] * 3 + [(k, words(rng, 30)) for k in range(10, 20)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(i, t, None if i == 3 else "en", "s", len(t or "")) for i, t in odd_rows(rng)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs = docs.selectExpr("*", *[f"{i} as {c}" for i, c in enumerate(CLASHING)])
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(k, 1, int(k % 2 == 0)) for k in range(10, 20)] + [(None, 1, 1), (2, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs, rows


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_clashing_names(spark, odd, name, stage):
    folder, docs, rows = odd
    out = stage(spark, docs, folder)
    got = out.collect()
    if name == "packing":
        assert {r["doc_id"] for r in got} == {r[0] for r in rows}
        return
    assert out.columns == docs.columns
    assert all(tuple(r)[5:] == tuple(range(len(CLASHING))) for r in got)
    texts = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got)
    given = sorted((i is None, i or 0, t or "") for i, t, *_ in rows)
    if name == "toxicity":
        assert set(texts) <= set(given)
    elif name == "exact_dedup":
        # null and empty are equal, a blank is not; the null id stays only with its own text
        assert texts == sorted({t: k for k in sorted(given, reverse=True) for t in [k[2] if k[2].strip() else f"{k[2][:1]}"]}.values())
    elif name == "simhash_near_dedup":
        assert [k[:2] for k in texts] == sorted({t: k[:2] for k in sorted(given, reverse=True) for t in [k[2].strip()]}.values())
    else:
        assert len(got) == len(rows)
        assert sum(len(t.split()) for _, _, t in texts) == sum(len(t.split()) for t in {t for _, _, t in given}) + 1  # "y" twice, being short


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_empty_tables(spark, odd, name, stage):
    folder, docs, _ = odd
    assert stage(spark, docs.where("false"), folder).isEmpty()
