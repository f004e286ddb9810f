import itertools
import re

import numpy as np
from corpus import SF

from starmill.llm import filter_audit
from starmill.llm.queries import QUERIES


def brute_masks(docs):
    """(part, set of failed filters) for each (doc_id, text, lang)."""
    out = []
    for key, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = set()
        if len(words) < 100:
            failed.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            failed.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            failed.add("C")
        if re.search(r"[#$%&*|]", text):
            failed.add("D")
        if key is not None and any(
            k is not None and k < key and (t or "") == text for k, t, _ in docs
        ):
            failed.add("E")
        out.append((lang or "", failed))
    return out


def brute(docs, labels):
    """Every order walked document by document."""
    good = {k for k, quality, _ in labels if quality == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    masks = brute_masks(docs)
    rows = {}
    for part in {p for p, _ in masks}:
        own = [(d[0], f) for d, (p, f) in zip(docs, masks) if p == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                out = [(k, f) for k, f in left if name in f]
                left = [(k, f) for k, f in left if name not in f]
                shares[name] += len(out)
                rows[part, "".join(order), step] = [
                    len(left), len(out), sum(name in f for _, f in own) - len(out),
                    sum(f == {name} for _, f in own), sum(k in good for k, _ in out),
                    sum(k in toxic for k, _ in out),
                ]
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(shares[order[step - 1]])
    return rows


def as_dict(df):
    found = {}
    for r in df.collect():
        key = (r.part, r.filter_order, r.step)
        assert key not in found
        found[key] = [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost,
                      r.shapley]
    return found


def test_whole_table_matches_brute_force(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [
        (r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()
    ]
    found = QUERIES["op13_filter_audit"](spark, SF)
    assert as_dict(found) == brute(docs, labels)
    assert dict(found.dtypes)["shapley"] == "bigint" and dict(found.dtypes)["step"] == "int"


def test_unclean_rows(spark):
    long = "word " * 30_000 + "End"
    texts = [
        (5, "same text", "en"), (5, "same text", "de"), (3, "same text", None), (3, "same text", ""),
        (None, "same text", "en"), (None, None, None), (7, None, "en"), (8, "", "en"), (9, long, "en"),
        (9, long, "en"), (10, long, "de"), (11, "ABC|DEF", "en"), (12, "É ü\x0b\x1c# x", "de"),
    ]
    labels = [(5, 1, 0), (5, 0, 1), (None, 1, 1), (10, None, 1), (3, 1, None), (99, 1, 1), (8, 0, 0)]
    docs = spark.createDataFrame(
        [(*t, 1, True) for t in texts],
        "doc_id long, text string, lang string, mask int, digest boolean",
    )
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert as_dict(filter_audit.audit(docs, known)) == brute(texts, labels)
    assert as_dict(filter_audit.audit(docs, known.limit(0))) == brute(texts, [])
    assert filter_audit.audit(docs.limit(0), known).count() == 0


def test_walk_visits_every_set_of_active_filters():
    draw = np.random.default_rng(3)
    for bits in (1, 3, 5):
        tallies = draw.integers(0, 9, (4, 1 << bits, 3))
        states = filter_audit.walk(tallies, bits)
        for active in range(1 << bits):
            left = [m for m in range(1 << bits) if not m & active]
            assert (states[:, active] == tallies[:, left].sum(axis=1)).all()
