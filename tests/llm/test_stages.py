"""Every stage of the pipeline against plain Python, on rows with nulls, empty and long texts, repeats and clashing columns."""

from collections import Counter

import pyarrow as pa
import pytest

from colophon.llm import mixing, quality, secrets
from colophon.llm.textblocks import text_view
from tests.llm.conftest import SHAPE, prose
from tests.llm.test_mixing_sharding_packing import n_words
from tests.llm.test_ngram_join import brute

BACKTICK = "`"
SECRET = "k3J9xQ7vLm2PzR8tYw5N"


@pytest.fixture(scope="module")
def rows(corpus):
    junk = [(200 + k, "#$%& *** !!! ||| " * (3 + k) + prose(k, 2).upper(), "en", "s0", None, 1, "x", "y") for k in range(20)]
    hidden = [(300 + k, prose(400 + k, 30) + f" credential {SECRET} " + ("password = hunter22" if k % 2 else ""), "en", "s1", None, 1, "x", None) for k in range(4)]
    return corpus + junk + hidden


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    marks = [(r[0], 0 if r[0] is not None and 200 <= r[0] < 300 else 1, 0) for r in rows if r[0] is None or r[0] % 3]
    spark.createDataFrame([*marks, (1, None, None), (9999, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    spark.createDataFrame(rows, SHAPE).repartition(3).write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([], SHAPE).write.parquet(f"file://{folder}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/none/labels.parquet")
    return f"file://{folder}"


def test_stages_against_plain_python(spark, sf_dir, rows):
    import corpus_pipeline as p

    stages = dict(p.STAGES)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ranker = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    # 1. what the ranking scores at the threshold or above stays
    good = stages["quality_classifier"](spark, docs, sf_dir)
    score = lambda t: ranker.score(quality.features(*text_view(pa.array([t], pa.string()))))[0]
    want = [r for r in rows if score(r[1]) >= quality.CUT]
    assert good.columns == docs.columns and Counter(map(tuple, good.collect())) == Counter(want)
    assert 0 < len(want) < len(rows)

    # 2. the least id of each component, one row of it; rows without an id are left alone
    single = stages["ngram_jaccard_join"](spark, spark.createDataFrame(want, SHAPE), sf_dir)
    groups = brute([r for r in want if r[0] is not None])
    least = {r[0] for r in want if r[0] is not None and groups[r[0]][1] == r[0]}
    kept = [min((r for r in want if r[0] == k), key=lambda r: (r[1] is not None, r[1] or "")) for k in least] + [r for r in want if r[0] is None]
    assert Counter((r.doc_id, r.text) for r in single.collect()) == Counter((r[0], r[1]) for r in kept) and single.columns == docs.columns

    # 3. every secret is masked, everything else stays
    hidden = stages["secret_scans"](spark, spark.createDataFrame(kept, SHAPE), sf_dir)
    words = secrets.dictionary(spark.createDataFrame(kept, SHAPE))
    masked = {(r[0], None if r[1] is None else secrets.redact(r[1], secrets.scan(r[1], words)[1])) for r in kept}
    got = hidden.collect()
    assert {(r.doc_id, r.text) for r in got} == masked and hidden.columns == docs.columns
    assert all(SECRET not in (r.text or "") and "hunter22" not in (r.text or "") and (r.text is None or r.n_chars == len(r.text)) for r in got)

    # 4. copies as the mix takes them
    shown = spark.createDataFrame(got, SHAPE)
    mixed = stages["mixing"](spark, shown, sf_dir).collect()
    times = Counter()
    for r in mixing.schedule(shown).collect():
        times[r.doc_id] += r.times
    assert Counter(r.doc_id for r in mixed) == +times and {tuple(r) for r in mixed} <= {tuple(r) for r in got}

    # 5. a place for each
    packed = stages["packing"](spark, spark.createDataFrame(mixed, SHAPE), sf_dir).collect()
    sizes = {r.doc_id: n_words(r.text) for r in mixed}
    assert Counter(r.doc_id for r in packed) == Counter(r.doc_id for r in mixed) and all(r.n_tokens == sizes[r.doc_id] <= r.bucket_length for r in packed)
    assert len({(r.batch, r.row) for r in packed}) == len(packed)
    assert Counter(r.doc_id for r in p.run(spark, sf_dir).collect()) == Counter(r.doc_id for r in packed)


def test_empty_table(spark, sf_dir):
    import corpus_pipeline as p

    assert p.run(spark, f"{sf_dir}/none").count() == 0


def test_columns_of_any_name(spark, rows, tmp_path):
    """Names with dots and spaces, and names that operators use themselves, pass through every stage."""
    import corpus_pipeline as p

    extra = ["a.b", "c`d", "c d", "__text", "__id", "__score", "__row", "__r", "__t", "__n", "__k", "__copy", "score", "size", "component_id", "__Text", "target", "times"]
    extra = [c for k, c in enumerate(extra) if c.lower() not in [x.lower() for x in extra[:k]]]
    docs = spark.createDataFrame([(*r[:5], *extra) for r in rows], "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c.replace(BACKTICK, BACKTICK * 2)}` string" for c in extra))
    spark.createDataFrame([(r[0], int(r[0] % 2)) for r in rows if r[0] is not None], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.columns == docs.columns, name
        assert all(tuple(r)[5:] == tuple(extra) for r in out.collect()), name
    assert p.STAGES[-1][1](spark, docs, f"file://{tmp_path}").count() == len(rows)


def test_secrets_of_one_long_run_cost_linear_time():
    import time

    for unit in ("auth", "token=", "secret_", "authK3J9xQ7vLm2PzR8t"):
        text = unit * (1_000_000 // len(unit)) + "1"
        began = time.process_time()
        secrets.scan(text)
        short = time.process_time() - began
        began = time.process_time()
        secrets.scan(text + text)
        assert time.process_time() - began < 4 * short + 1, unit
    began = time.process_time()
    secrets.scan("auth" * 250_000 + "1")
    assert time.process_time() - began < 3  # on a slow machine; half a second on an idle one
