"""The filter audit against SQL and against every order applied document by document."""

import re
from itertools import permutations

from souk.llm import op11_audit
from tests.llm.test_tables import register, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def applied(rows, labels):
    """Every order applied to every document in turn."""
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = {}
    for i, text, source in rows:
        text, words = text or "", WORD.findall(text or "")
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > first[text]}
        parts.setdefault(source or "", []).append((fails, i in good, i in toxic))
    out, shapley = {}, {}
    for part, docs in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if d[0][letter]]
                left = [d for d in left if not d[0][letter]]
                redundant = sum(d[0][letter] for d in docs) - len(gone)
                unique = sum(d[0][letter] and sum(d[0].values()) == 1 for d in docs)
                out[part, order, step] = (len(left), len(gone), redundant, unique, sum(d[1] for d in gone), sum(d[2] for d in gone))
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_of_odd_rows(spark, odd_docs, duck):
    """Nulls, empty and long texts, copies over sources, repeated rows and ids, several labels of an id, clashing columns."""
    base = [tuple(r) for r in odd_docs.select("doc_id", "text", "source").collect()]
    many = [f"word{i} and # Symbol{i % 3} " * (i % 40) for i in range(60)] + ["CAPS " * 60, " lead and trail \n" * 30]
    base += [(100 + i, t, [None, "", "src0", "src9"][i % 4]) for i, t in enumerate(many)] + [(400 - i, many[i % 7], f"src{i % 2}") for i in range(50)]
    base += [(None, many[3], "src0"), (None, many[3], "src1"), (105, many[8], "src0"), (105, many[5], "src1"), (105, many[5], "src1")]
    marks = [(i, i % 2, (i // 3) % 2) for i in range(0, 400, 3)] + [(105, 1, 0), (105, 0, 1), (6, None, None), (None, 1, 1), (99999, 1, 1)]
    docs = spark.createDataFrame(base, "doc_id long, text string, source string")
    labels = spark.createDataFrame(marks, "doc_id long, quality long, toxic long")
    register(duck, docs, "documents")
    register(duck, labels, "labels")
    wide = docs.selectExpr("*", "1 as part", "'x' as word", "2 as n", "'y' as _text", "3 as digest").withColumnRenamed("text", "body")
    got = same(op11_audit.audit(wide, labels.selectExpr("*", "7 as part"), text_col="body"), duck, op11_audit.oracle())
    names = sorted(["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])
    rows = [dict(zip(names, r, strict=True)) for r in got]
    expected = applied(base, marks)
    assert len(rows) == len(expected) == 600 * len({s or "" for _, _, s in base})
    for r in rows:
        assert expected[r["part"], r["filter_order"], r["step"]] == tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))


def test_audit_of_empty_tables(spark, empty_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op11_audit.audit(empty_docs, none).count() == 0
    one = spark.createDataFrame([(None, None, None)], "doc_id long, text string, source string")
    rows = op11_audit.audit(one, none).collect()
    assert len(rows) == 600 and {r["removed"] for r in rows if r["filter_order"][r["step"] - 1] == "A"} == {1} and {r["part"] for r in rows} == {""}
