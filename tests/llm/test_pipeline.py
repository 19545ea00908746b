import corpus_pipeline
from derlem.llm import pii, toxicity
from derlem.llm.common import table
from test_decontaminate import force as contamination
from test_packing import check as check_packing
from test_simhash import groups_by_force, slow_fingerprint


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    seen = [rows(docs)]
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frames[-1], sf)
        assert out.schema == docs.schema
        out = spark.createDataFrame(out.collect(), docs.schema)
        frames.append(out)
        seen.append(rows(out))
    before, clean, single, fresh, redacted = seen

    model = toxicity.train(docs, table(spark, sf, "labels"))
    bad = {r.doc_id for r in toxicity.scores(docs, model).collect() if r.score >= 0.7}
    assert bad and clean.keys() == before.keys() - bad

    prints = {i: slow_fingerprint(r.text) for i, r in clean.items()}
    root = groups_by_force(sorted(set(prints.values())))
    least = {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    assert single.keys() == set(least.values()) and len(single) < len(clean)

    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    hit = {i for i, n, h, _ in contamination([(i, r.text) for i, r in single.items()], items) if h and 20 * h >= n}
    assert hit and fresh.keys() == single.keys() - hit
    assert all(fresh[i] == before[i] for i in fresh)

    assert redacted.keys() == fresh.keys()
    for i, r in redacted.items():
        spans = pii.base_spans(fresh[i].text)
        assert (r.text == fresh[i].text) <= (not spans) and r.n_chars == len(r.text)
        assert not any(fresh[i].text[a:b] in r.text and k == 0 for a, k, b in spans)
    assert sum(r.text != fresh[i].text for i, r in redacted.items()) < len(fresh) / 3

    packed = corpus_pipeline.STAGES[-1][1](spark, frames[-1], sf).collect()
    n, bound = check_packing(packed, [(i, r.text) for i, r in redacted.items()], 2048)
    assert n <= bound + 2


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_odd_rows_through_all_stages(spark, sf, tmp_path):
    """Repeated rows, one id for two texts, null ids and texts: the row with a text of its own stays, and one row of each group of copies."""
    docs = table(spark, sf, "documents")
    have = [tuple(r) for r in docs.limit(60).collect()]
    i, text = docs.columns.index("doc_id"), docs.columns.index("text")
    make = lambda r, **new: tuple(new.get(c, v) for c, v in zip(docs.columns, r))
    own = "neither copied nor linked: " + " ".join(f"word{k}" for k in range(40))
    odd = [*have, have[0], have[0], make(have[1], text=own), make(have[2], doc_id=None), make(have[2], doc_id=None), make(have[3], doc_id=None, text=None), make(have[3], text="")]
    frame = spark.createDataFrame(odd, docs.schema)
    kept = corpus_pipeline.drop_near_duplicates(spark, frame, sf).collect()
    prints = [slow_fingerprint(r[text]) for r in odd]
    root = groups_by_force(sorted(set(prints)))
    assert len(kept) == len({root[p] for p in prints}) == len({root[slow_fingerprint(r.text)] for r in kept})
    assert any(r.text == own and r.doc_id == have[1][i] for r in kept)
    for name in ("documents", "labels", "benchmark"):
        (frame if name == "documents" else table(spark, sf, name)).write.parquet(f"{tmp_path}/odd/{name}.parquet")
        table(spark, sf, name).limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/odd").count() > 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_a_text_of_one_short_word_passes_the_first_stage(spark):
    """On the tables of sf0.01 the model has stretches, which short texts are compared with."""
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    short = spark.createDataFrame([(-1 - i, text, "en", "src0", len(text)) for i, text in enumerate(("", "a", "ab", "abc", "a b"))], docs.schema)
    kept = corpus_pipeline.drop_toxic(spark, docs.unionByName(short), sf)
    assert kept.where("doc_id < 0").count() == 5
