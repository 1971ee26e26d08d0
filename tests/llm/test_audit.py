"""The filter audit against plain application of the filters in every order."""

import random
import re
from itertools import permutations

from twinlens.llm import audit

DOCS = "doc_id long, text string, source string, n long, mask string, digest string"


def plain(rows, labels):
    """Every order applied to every document, one by one."""
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)

    def fails(i, text):
        text = text or ""
        words = [w for w in re.split("[ \t-\r]+", text) if w]
        return {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(set(text) & set("#$%&*|")),
            "E": i is not None and first[text] < i,
        }

    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], fails(r[0], r[1])) for r in rows if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in left if x[f]]
                left = [(i, x) for i, x in left if not x[f]]
                total[f] += len(gone)
                failing = sum(x[f] for _, x in own)
                alone = sum(x[f] and sum(x.values()) == 1 for _, x in own)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(total[key[1][key[2] - 1]])
    return out


def test_audit_equals_every_order(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma", "DELTA", "#tag", "e|f", "Über", "\U0001f600", "x y", "100%"]
    texts = [None, "", " \t\n", "one", "a" * 5000, "\x1c\x1d word\x85word"] + [
        rng.choice([" ", "\n", "\x0b \x0c"]).join(rng.choice(words[: rng.choice([3, 6, 10])]) + (str(rng.randrange(400)) if rng.random() < 0.5 else "") for _ in range(rng.choice([3, 199, 200, 201, 450]))) for _ in range(40)
    ]
    texts += [" ".join(f"w{i}" for i in range(200)), " ".join(["w"] * 100 + [f"w{i}" for i in range(99)] + ["w"])] + [rng.choice(texts) for _ in range(40)]
    rows = [(rng.randrange(60) if rng.random() < 0.2 else i, t, rng.choice([None, "", "web", "books"]), 1, "m", "d") for i, t in enumerate(texts)] + [(None, texts[8], "web", 1, "m", "d")] * 2
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(80)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    got = audit.filter_audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in got} == plain(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_empty_tables(spark):
    documents, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(documents, labels).count() == 0
    one = audit.filter_audit(spark.createDataFrame([(1, None, None, 1, "", "")], DOCS), labels).collect()
    assert len(one) == 600
    assert {r["shapley"] for r in one} == {0, 120}


def test_polynomial():
    """A document that fails two filters is half of each one's value; corners count the union."""
    counts = [0] * 32
    counts[0b00011], counts[0b00100], counts[0] = 4, 3, 10
    p = audit.Removals(counts)
    assert [p.shapley(i) for i in range(5)] == [2, 2, 3, 0, 0]
    assert p.corner[0] == 0 and p.corner[0b00001] == 4 and p.corner[0b00111] == 7 == p.corner[31]
