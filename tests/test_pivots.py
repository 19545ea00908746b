import numpy as np
import pytest
from pyspark.sql import functions as F

from derlem.operators import retrieval
from derlem.operators.pivots import Pivoted

SCHEMA = "file_id long, chunk_index int, text string, embedding array<float>"


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    vectors = centres[rng.integers(0, 12, 3000)] + rng.normal(scale=0.15, size=(3000, 16))
    rows = [(int(i % 700), int(i), f"t{i}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(int(800 + i), 0, "same", rows[5][3]) for i in range(30)]  # ties
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [1.0] * 15 + [None], [1.0, 2.0], [float("inf")] * 16]
    rows += [(900 + i, 0, None, v) for i, v in enumerate(odd)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def index(chunks, tmp_path_factory):
    return Pivoted.write(chunks, str(tmp_path_factory.mktemp("pivots")), pivots=40)


def rows(found):
    return [(r.id, round(r.score, 9) if r.score == r.score else "nan") for r in found.collect()]


def test_the_same_files_as_scoring_all(chunks, index):
    known = {r.chunk_index: r.embedding for r in chunks.where("file_id < 700 and chunk_index in (5, 77, 1234)").collect()}
    queries = [*known.values(), list(np.random.default_rng(9).normal(size=16)), [-x for x in known[77]], [0.0] * 16, [1.0, 2.0]]
    for vector in queries:
        column = F.array(*[F.lit(float(x)) for x in vector])
        for k in (1, 15):
            assert rows(index.search(vector, k)[0]) == rows(retrieval.top(retrieval.semantic(chunks, column), k))


def test_parts_out_of_reach_are_not_read(chunks, index):
    vector = chunks.where("chunk_index = 77").first().embedding
    found, scored = index.search(vector, 10)
    assert found.count() == 10 and scored.count() * 4 < chunks.count()
    assert scored.select("part").distinct().count() * 2 < len(index.parts)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(angle" in plan


def test_no_chunks_and_no_vectors(spark, tmp_path):
    none = Pivoted.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "a"))
    assert none.search([1.0, 2.0], 3)[0].collect() == []
    zero = Pivoted.write(spark.createDataFrame([(1, 0, "x", [0.0, 0.0]), (2, 0, "y", None)], SCHEMA), str(tmp_path / "b"))
    assert zero.search([1.0, 2.0], 3)[0].collect() == []
