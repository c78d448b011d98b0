import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from usagelens.llm import fill_middle
from usagelens.llm.common import table
from usagelens.llm.queries import op12_fill_middle


def by_lines(doc_id, text, percent=100, percent_spm=50):
    """n, form, prefix and middle lengths and the output, from a list of lines."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (len(lines) + 1) for x in h[:2])
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(lines), "plain", None, None, text
    if h[3] % 100 < percent_spm:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("size", [0, 1, 7, 8, 63, 64, 65, 511, 512, 513, 5000])
def test_rank_and_select(size):
    for share in (0, 0.01, 0.5, 1):
        bits = np.random.default_rng(size).random(size) < share
        v = fill_middle.BitVector(bits)
        assert v.rank(np.arange(size + 1)).tolist() == [0, *np.cumsum(bits).tolist()]
        assert v.ones == bits.sum() and v.select(np.arange(v.ones)).tolist() == np.flatnonzero(bits).tolist()


def test_cuts_of_sliced_arrays():
    r = random.Random(2)
    texts = ["".join(r.choice("a\né漢\U0001f389b\n") for _ in range(r.randint(0, 40))) for _ in range(500)]
    h = np.array([[r.randrange(1 << 32) for _ in texts] for _ in range(2)])
    n, first, second, prefix, middle = fill_middle.line_cuts(pa.array(["skipped", *texts, "x"])[1:-1], *h)
    for i, text in enumerate(texts):
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        a, b = sorted(int(x) % (len(lines) + 1) for x in h[:, i])
        p, m = "".join(lines[:a]), "".join(lines[a:b])
        assert (n[i], first[i], second[i], prefix[i], middle[i]) == (len(lines), len(p.encode()), len((p + m).encode()), len(p), len(m))


def test_query(spark, small):
    docs = {r.doc_id: r.text for r in table(spark, small, "documents").collect()}
    rows = op12_fill_middle(spark, small).collect()
    assert len(rows) == len(docs) and {r.form for r in rows} >= {"psm", "spm"}
    for r in rows:
        *counts, output = by_lines(r.doc_id, docs[r.doc_id])
        assert [r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256] == [*counts, hashlib.sha256(output.encode()).hexdigest()]
        assert r.restored_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_odd_documents(spark, odd_documents, no_documents):
    more = spark.createDataFrame([(50, "a <S> b\nc"), (51, "\n\n\n"), (52, "<P\n>x<S"), (53, "é\r\n漢"), (54, "x\n" * 60_000)], "doc_id bigint, text string")
    docs = odd_documents.select("doc_id", "text", "n_chars", "digest").unionByName(more, allowMissingColumns=True).withColumn("form", docs_form())
    want = [(d.doc_id, *by_lines(d.doc_id, d.text), d.text or "") for d in docs.collect()]
    assert sorted(map(tuple, fill_middle.transform(docs).collect()), key=repr) == sorted(want, key=repr)
    few = sorted(map(tuple, fill_middle.transform(docs, percent=30, percent_spm=0).collect()), key=repr)
    assert few == sorted([(d.doc_id, *by_lines(d.doc_id, d.text, 30, 0), d.text or "") for d in docs.collect()], key=repr)
    assert fill_middle.digest_documents(no_documents).count() == 0


def docs_form():
    from pyspark.sql import functions as F

    return F.lit("clash")
