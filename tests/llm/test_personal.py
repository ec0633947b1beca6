"""op13: spans of the patterns against plain regular expressions, the field's gradient, messages and added spans."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemara.llm import personal

PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
            if (kind == 0, kind == 1 and max(map(int, m.group().split("."))) <= 255, kind == 2 and 13 <= len(digits) <= 19 and doubled % 10 == 0, kind == 3 and 9 <= len(digits) <= 15)[kind]:
                out.append((kind, *m.span()))
    return out


def test_spans_equal_plain_patterns():
    rng = random.Random(3)
    parts = ["a", "b.", "@", "@", ".", "-", "+", "1", "23", "255", "300", ".4", ".5.6.7", " ", "(", ")", "%", "\n", "é", "٣", "4316522678525456", " 4316 5226 7852 5456", "+1 (743) 555-3824", "x.1@h2.example.com"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(40)))
        assert personal.base_spans(text) == plain_spans(text), text


def test_long_runs_take_time_in_proportion():
    for text in ("1" * 3_000_000, "a" * 3_000_000 + "@", "1 " * 1_000_000, "+1" + " " * 2_000_000, "@" * 300_000, "a@" * 300_000, "+1" * 500_000):
        assert personal.base_spans(text) == []


def words(text):
    return personal.words_in(text, personal.base_spans(text))


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    w = personal.together([words("call +1 (743) 555-3824 or (743) 555-3824 at 10:30 12.1.1.5 12.1.1.5"), words("a1@b.c2.com 77 a1@b and 4316522678525456 4316522678525457")])
    field = personal.Field(*[rng.normal(size=s) for s in ((personal.FEATURES, personal.LABELS), (personal.LABELS,) * 2, (len(personal.LINKS), personal.LABELS))])
    own, others = (rng.random(len(w.label)) < 0.7) * 1.0, (rng.random(len(w.label)) < 0.7) * 1.0
    _, grads = personal.loss_gradient(field, w, own, others)
    for x, g in zip(field, grads, strict=True):
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in x.shape)
            kept, x[at] = x[at], x[at] + 1e-5
            high = personal.loss_gradient(field, w, own, others)[0]
            x[at] = kept - 1e-5
            low, x[at] = personal.loss_gradient(field, w, own, others)[0], kept
            assert (high - low) / 2e-5 == pytest.approx(g[at], rel=1e-4, abs=1e-7)


def test_messages_give_exact_marginals_where_links_make_no_loop():
    rng = np.random.default_rng(2)
    text = "7 8 word 11 12 word 11"
    w = words(text)
    assert len(w.label) == 5 and w.skip.tolist() == [[2, 4, 0]]
    w = w._replace(label=np.array([0, 2, 0, 0, 0]))
    field = personal.Field(*[rng.normal(size=s) for s in ((personal.FEATURES, personal.LABELS), (personal.LABELS,) * 2, (len(personal.LINKS), personal.LABELS))])
    total = np.zeros((5, personal.LABELS))
    for y in itertools.product(range(personal.LABELS), repeat=5):
        if y[1] == 2:
            score = sum((w.feature[i] @ field.node)[y[i]] for i in (0, 2, 3, 4)) + sum(field.chain[y[a], y[b]] for a, b in w.chain) + sum(field.skip[k, y[i]] for i, j, k in w.skip if y[i] == y[j])
            total[range(5), y] += np.exp(score)
    assert personal.marginals(field, w, 200) == pytest.approx(total / total.sum(axis=1, keepdims=True), abs=1e-3)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        x = "4" + d(14)
        return next(x + c for c in "0123456789" if personal.luhn(x + c))

    made = [lambda: f"name{d(2)}.x@mail{d(1)}.example.com", lambda: f"{rng.randrange(1, 255)}.{rng.randrange(255)}.{rng.randrange(255)}.{rng.randrange(1, 255)}", card, lambda: f"+1 ({d(3)}) 555-{d(4)}", lambda: d(4)]
    texts = [" ".join(rng.choice(("the", "of", "word", "an")) + " " + rng.choice(made)() + " end" for _ in range(4)) for _ in range(200)]
    texts += [None, "", "plain words only", "phone +1 (743) 555-3824 then (743) 555-3824 once more", "card 4316522678525456 or 4316.5226.7852.5456 here", "to anes.09@mail5.example.com not anes.09@mail5 ok", "on 2024-01-02 at 10:30, 4785 of 3.14 by v1.2.3 for 10.1.1.2"]
    return spark.createDataFrame(list(enumerate(texts)) + [(3, "same"), (3, "same"), (None, "x9@y.com")], "doc_id long, text string")


def test_query_keeps_base_spans_and_adds_like_words(spark, docs):
    clash = docs.select("*", *[F.lit("mine").alias(c) for c in ("id", "h", "base", "Added", "spans")])
    text = {(r.doc_id, r.text) for r in docs.collect()}
    got = personal.span_index(clash).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    added = {}
    for key, t in text:
        spans = plain_spans(t)
        written = [f"{personal.KINDS[k]}:{a}:{b}" for k, a, b in spans]
        digest = hashlib.sha256(",".join(written).encode()).hexdigest()
        r = next(r for r in by[key] if r.base_sha256 == digest)
        assert [r[f"n_{k}"] for k in personal.KINDS] == [sum(s[0] == i for s in spans) for i in range(4)]
        all_spans = r.spans.split(",") if r.spans else []
        assert set(written) <= set(all_spans) and len(all_spans) == len(written) + r.n_added
        order = [(personal.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in all_spans]
        assert order == sorted(order)
        added[t] = [t[int(a) : int(b)] for a, b in (s.split(":")[1:] for s in all_spans if s not in written)]
    assert [v for t, v in added.items() if t and "once more" in t] == [["(743) 555-3824"]]
    assert [v for t, v in added.items() if t and "or 4316." in t] == [["4316.5226.7852.5456"]]
    assert [v for t, v in added.items() if t and "not anes" in t] == [["anes.09@mail5"]]
    assert [v for t, v in added.items() if t and "v1.2.3" in t] == [[]]
    assert sum(map(len, added.values())) == 3


def test_no_documents_and_none_to_learn_from(spark, docs):
    assert personal.span_index(docs.where("false")).collect() == []
    few = spark.createDataFrame([(1, "only words"), (2, None)], "doc_id long, text string")
    assert [(r.n_email, r.spans) for r in personal.span_index(few).orderBy("doc_id").collect()] == [(0, ""), (0, "")]


def test_the_field_labels_texts_in_which_no_pattern_matches():
    field = personal.taught([])
    field.node[personal.features_of("555-3824"), personal.KINDS.index("phone") + 1] = 5.0
    text = "call 555-3824 now"
    assert personal.base_spans(text) == []
    assert personal.spans_of([text, None, "", "only words", text], field) == [([], [(3, 5, 13)]), ([], []), ([], []), ([], []), ([], [(3, 5, 13)])]
