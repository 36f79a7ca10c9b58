"""Fill-in-the-middle against the contract's regular expression, and its defined cases."""

import hashlib
import random
import re

import pytest

from archgraph.llm.fill_middle import UNITS, digests, fill_in_middle, restore, units

GRAMMARS = {
    "token": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+",
    "word": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+",
    "line": r"[^\n]*\n|[^\n]+",
}
SCHEMA = "doc_id long, text string, FIM string, _text int"


def expected(doc_id, text):
    text = text or ""
    pieces = re.findall(GRAMMARS["token"], text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(pieces)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(pieces[:a]), "".join(pieces[a:b]), "".join(pieces[b:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    spm = h4 % 100 < 80
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, n, "spm" if spm else "psm", len(prefix), len(middle), sha(out), sha(text))


def texts():
    rnd = random.Random(4)
    letters = ["a", "b", " ", "\n", "\t", "\x0b", "é", "漢", "😀", " ", " ", "<", "S>", "<P", "\x85", "\r"]
    out = [None, "", " ", "x", "  x", "x  ", "<P", "a <S> b", "<M>", "S>a<", "<<S", "long text, " * 20_000, "y" * 100_000]
    return out + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(300)]


def test_equals_the_grammar(spark):
    rows = list(enumerate(texts())) + [(None, "no id at all"), (None, None), (7, "another text"), (7, "another text"), (-5, "negative id")]
    got = digests(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA))
    key = lambda r: tuple((x is not None, x) for x in r)
    found = sorted((tuple(r) for r in got.collect()), key=key)
    assert found == sorted((expected(i, t) for i, t in rows), key=key)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    assert digests(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_boundaries_cut_what_the_grammar_matches(spark, unit):
    rows = [(t or "",) for t in texts()]
    from pyspark.sql import functions as F

    for r in spark.createDataFrame(rows, "text string").select("text", units(F.col("text"), unit).alias("x")).collect():
        assert r.x == re.findall(GRAMMARS[unit], r.text)


def test_outputs_are_read_back_and_columns_stay(spark):
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts())], SCHEMA)
    from pyspark.sql import functions as F

    for unit in UNITS:
        made = fill_in_middle(docs, unit, rate=100, seed=7)
        assert made.columns == [*docs.columns, "_fim"]
        rows = made.select("text", "_fim.*", restore(F.col("_fim.output"), F.col("_fim.form")).alias("back"), "_text", "FIM", "doc_id").collect()
        for r in rows:
            assert r.back == (r.text or "") and r._text == r.doc_id and r.FIM == "x"
            if r.form != "plain":
                assert r.prefix + r.middle + r.suffix == r.text
        assert sum(r.form != "plain" for r in rows) > 200


def test_the_plan_is_one_map(spark):
    plan = spark._jvm.PythonSQLUtils.explainString(digests(spark.createDataFrame([(1, "a b", "x", 1)], SCHEMA))._jdf.queryExecution(), "formatted")
    assert "Exchange" not in plan and "MapIn" not in plan and "EvalPython" not in plan
