"""Filters against brute force and held-out labels; mixing against a step-by-step version."""

import itertools
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import common, crf_lines, mixing, ordinal, toxicity

SF = "/root/testdata/sf0.01"
TEXTS = [None, "", "\n \n", "one", "a b\na b\n\na b", "x " * 100, "w1 w2 w3 w4 w5 w6 w7 w8 w1 w2 w3 w4 w5 w6 w7 w8 end",
         "# $ | <b> % & *", "no break space \x1c here", "Line one.\nLine two.\r\nLine one.\n" * 3,
         " ".join(f"u{i}" for i in range(4000)), "é ü\v\f\tö"]


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return common.table(spark, SF, "labels")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, i, 0.5, True, None, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", 0, 0.0, False, "s", "y")]
    return spark.createDataFrame(
        rows, "doc_id long, text string, score int, tail double, kept boolean, source string, lang string")


def brute_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    where = {}
    for i, x in enumerate(windows):
        where.setdefault(x, []).append(i)
    covered = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts_equal_the_definition(docs):
    for t in TEXTS + [r.text for r in docs.limit(150).collect()]:
        n, *_, repeats = base = brute_base(t)
        got = crf_lines.judge(t, crf_lines.Field())
        assert got[:5] == base
        assert got[5] == (n < 20 or 100 * repeats > 30 * n)


WIDE_SPACES = [chr(c) for c in (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


@pytest.mark.parametrize("space", WIDE_SPACES)
def test_lines_of_wide_spaces_are_lines_with_a_word(space):
    texts = [f"one two three\n{space}\nfour five", space, f"{space}{space} \n {space}", f"a{space}b. c\n" * 9,
             f"{space}\n" * 30]
    field = crf_lines.fit([(t, i % 2) for i, t in enumerate(texts)])
    for t in texts:
        assert crf_lines.judge(t, field)[:5] == brute_base(t)


def test_wide_spaces_in_tables(spark):
    rows = [(i, f"word {i}\n{s}\nmore words here. " * 9) for i, s in enumerate(WIDE_SPACES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    field = crf_lines.learn(docs, labels)
    got = {r.doc_id: r for r in crf_lines.judged(docs, field).collect()}
    assert all(tuple(got[i])[1:6] == (b := brute_base(t)) and b[0] > 0 for i, t in rows)
    assert {r.doc_id for r in crf_lines.kept_rows(docs, field).collect()} == {
        i for i in got if got[i].kept}


def test_viterbi_finds_the_best_labelling():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 8):
        field = crf_lines.Field(rng.normal(size=(crf_lines.N_FEATURES, 2)), rng.normal(size=(2, 2)))
        x = rng.random((n, crf_lines.N_FEATURES))
        e = x @ field.emit

        def value(y):
            return sum(e[i, k] for i, k in enumerate(y)) + sum(field.move[a, b] for a, b in itertools.pairwise(y))

        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert field.labels(x).tolist() == list(best)


def test_the_field_learns_its_gradient_well_enough(docs, labels):
    field = crf_lines.learn(docs, labels)
    rows = crf_lines.judged(docs, field).join(labels, "doc_id").collect()
    poor, good = [r for r in rows if not r.quality], [r for r in rows if r.quality]
    assert sum(r.kept for r in poor) <= 0.05 * len(poor)
    assert all(r.kept for r in good if not r.base_failed)


def windows_of(lengths, rng):
    x = rng.random((len(lengths), max(lengths), crf_lines.N_FEATURES))
    mask = (np.arange(max(lengths)) < np.array(lengths)[:, None]).astype(float)
    return x * mask[:, :, None], mask


def test_chain_sums_equal_all_labellings():
    rng = np.random.default_rng(5)
    lengths = [1, 3, 5]
    x, mask = windows_of(lengths, rng)
    e, move = x @ rng.normal(size=(crf_lines.N_FEATURES, 2)), rng.normal(size=(2, 2))
    z, labels, moves = crf_lines.chain_sums(e, move, mask)
    for i, n in enumerate(lengths):
        ways = list(itertools.product((0, 1), repeat=n))
        w = np.array([np.exp(sum(e[i, t, k] for t, k in enumerate(y)) + sum(
            move[a, b] for a, b in itertools.pairwise(y))) for y in ways])
        assert z[i] == pytest.approx(np.log(w.sum()))
        for t in range(max(lengths)):
            for k in (0, 1):
                here = sum(v for v, y in zip(w, ways) if t < n and y[t] == k) / w.sum()
                assert labels[i, t, k] == pytest.approx(here)
                for j in (0, 1):
                    if t + 1 < max(lengths):
                        both = sum(v for v, y in zip(w, ways) if t + 1 < n and y[t:t + 2] == (j, k))
                        assert moves[i, t, j, k] == pytest.approx(both / w.sum())


def test_the_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(6)
    x, mask = windows_of([4, 1, 6, 2], rng)
    emit, move = rng.normal(size=(crf_lines.N_FEATURES, 2)), rng.normal(size=(2, 2))
    _, labels, moves = crf_lines.chain_sums(x @ rng.normal(size=emit.shape), rng.normal(size=(2, 2)), mask)
    data = x, mask, labels, moves, rng.random(4)
    _, g_emit, g_move = crf_lines.loss(emit, move, *data)
    for i in np.ndindex(emit.shape):
        d = np.zeros_like(emit)
        d[i] = 1e-5
        up, down = crf_lines.loss(emit + d, move, *data)[0], crf_lines.loss(emit - d, move, *data)[0]
        assert g_emit[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)
    for i in np.ndindex(2, 2):
        d = np.zeros_like(move)
        d[i] = 1e-5
        up, down = crf_lines.loss(emit, move + d, *data)[0], crf_lines.loss(emit, move - d, *data)[0]
        assert g_move[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_hidden_labels_keep_to_the_texts_labels():
    rng = np.random.default_rng(7)
    x, mask = windows_of([5, 5, 3, 7, 2, 6], rng)
    text, good = np.array([0, 0, 1, 2, 3, 3]), np.array([1, 0, 1, 0])
    for _ in range(5):
        field = crf_lines.Field(3 * rng.normal(size=(crf_lines.N_FEATURES, 2)), rng.normal(size=(2, 2)))
        labels, moves = crf_lines.hidden_labels(field, x, mask, text, good)
        content = np.bincount(text, labels[:, :, 1].sum(axis=1)) / np.bincount(text, mask.sum(axis=1))
        assert (content[good == 1] >= crf_lines.GOOD_CONTENT).all()
        assert (content[good == 0] <= crf_lines.POOR_CONTENT).all()
        assert labels.sum(axis=2) == pytest.approx(mask)
        assert moves.sum(axis=(2, 3)) == pytest.approx(mask[:, 1:])


def test_lines_get_labels_of_their_own(docs, labels):
    field = crf_lines.learn(docs, labels)
    known = docs.join(labels, "doc_id").select("doc_id", "text", "quality").collect()
    held = [r for r in known if common.held_out(r.doc_id) and r.text]
    rough = [line for r in held if not r.quality for line in r.text.split("\n") if line.split() and (
        sum(map(line.count, crf_lines.SYMBOLS)) * 2 > len(line.split()) or line.isupper())]
    rng = np.random.default_rng(8)
    right = lines = 0
    for r in held:
        whole = [line for line in r.text.split("\n") if line.split()]
        if r.quality and len(whole) > 3:
            at, n = int(rng.integers(1, len(whole))), int(rng.integers(1, 4))
            block = [rough[i] for i in rng.integers(0, len(rough), n)]
            spliced = crf_lines.visible_lines("\n".join([*whole[:at], *block, *whole[at:]]))
            want = [1] * at + [0] * n + [1] * (len(whole) - at)
            right += sum(map(int.__eq__, field.labels(crf_lines.line_features(spliced)).tolist(), want))
            lines += len(want)
    assert lines > 300 and right >= 0.95 * lines
    shares = [crf_lines.judge(r.text, field)[6] for r in known if not r.quality]
    assert sum(0 < s < 1 for s in shares) >= 0.05 * len(shares)


def test_quality_of_odd_rows(odd):
    field = crf_lines.Field()
    rows = crf_lines.judged(odd, field).collect()
    assert len(rows) == len(TEXTS) + 1 and rows[0].n_words == 0 and rows[0].base_failed
    assert [r.doc_id for r in crf_lines.kept_rows(odd, field).collect()] == [10]
    assert crf_lines.kept_rows(odd, field).columns == odd.columns


def test_toxicity_on_held_out_labels(docs, labels):
    model = toxicity.learn(docs, labels)
    rows = toxicity.scored(docs, model).join(labels, "doc_id").filter("held_out").collect()
    clean, toxic = [r for r in rows if not r.toxic], [r for r in rows if r.toxic]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.5 * len(toxic)


def test_noisy_or_and_blame(spark):
    sample = [(f"good words number {i}. More of them here.", 0) for i in range(60)] + \
        [(f"good words number {i}. You nasty thing! More.", 1) for i in range(20)]
    model = toxicity.fit(sample)
    z = model.sentences("Fine words. You NASTY thing? Fine.")
    assert toxicity.noisy_or(z) == pytest.approx(1 - np.prod(1 - 1 / (1 + np.exp(-z))))
    df = spark.createDataFrame([(1, "Fine words. You NASTY thing? Fine.\nAll good."), (2, "good"), (3, None)],
                               "doc_id long, text string")
    found = toxicity.offending(df, model).collect()
    assert [(r.doc_id, r.place, r.sentence) for r in found] == [(1, 1, "You NASTY thing")]
    scores = {r.doc_id: r for r in toxicity.scored(df, model).collect()}
    assert scores[1].predicted == 1 and scores[1].worst_sentence == 1 and scores[2].predicted == 0
    assert scores[3].score == 0 and scores[3].worst_sentence is None
    assert [r.doc_id for r in toxicity.clean(df, model).collect()] == [2, 3]


def test_nothing_to_learn_from(spark, odd, labels):
    none = labels.limit(0)
    model = toxicity.learn(odd, none)
    assert {r.score for r in toxicity.scored(odd, model).collect()} == {0.0}
    assert toxicity.clean(odd, model).count() == odd.count()
    assert {r.kept for r in ordinal.graded(odd, ordinal.learn(odd, none)).collect()} == {True}
    assert crf_lines.learn(odd, none).labels(np.ones((1, crf_lines.N_FEATURES))).tolist() == [1]
    empty = odd.limit(0)
    assert not toxicity.scored(empty, model).count() + ordinal.graded(empty, ordinal.fit([])).count()
    assert not crf_lines.judged(empty, crf_lines.Field()).count()


def test_held_out_rows_are_never_learnt_from(spark):
    rows = [(i, f"text {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(1, None, None), (None, 1, 1)],
                                  "doc_id long, quality int, toxic int")
    got = common.labelled_sample(docs, marks, ["quality"], 1000, 10_000)
    assert sorted(int(t.split()[1]) for t, _ in got) == [i for i in range(200) if not common.held_out(i)]
    assert len(common.labelled_sample(docs, marks, ["quality"], 30, 10_000)) == 30
    assert len(common.labelled_sample(docs, marks, ["quality"], 1000, 70)) <= 10
    scored = toxicity.scored(docs, toxicity.Model({}, None)).collect()
    assert all(r.held_out == common.held_out(r.doc_id) for r in scored)


def test_grades_are_ordered_and_right_on_held_out_labels(docs, labels):
    model = ordinal.learn(docs, labels)
    assert model.thresholds[0] < model.thresholds[1]
    rows = ordinal.graded(docs, model).join(labels, "doc_id").collect()
    rows = [r for r in rows if common.held_out(r.doc_id)]
    mean = {q: np.mean([r.expected_grade for r in rows if r.quality == q]) for q in (0, 1)}
    assert mean[1] > mean[0] + 0.5
    assert np.mean([r.kept for r in rows if r.quality]) > 0.95


def test_the_ordinal_gradient_climbs():
    sample = [("good words", 1, 0)] * 30 + [("poor ###", 0, 0)] * 30 + [("good nasty", 1, 1)] * 30
    model, cache = ordinal.fit(sample), ordinal._Features()
    best = [model.tails(t, cache).sum() for t, _, _ in (sample[0], sample[30], sample[60])]
    assert best[0] > 1.6 and best[1] < 0.4 and 0.6 < best[2] < 1.4


def deal(budget, children):
    """Shares of {name: (capacity, weight)}: fill the neediest first, then whole-number shares."""
    full = set()
    while True:
        rest = {n: w for n, (c, w) in children.items() if n not in full}
        left = budget - sum(children[n][0] for n in full)
        over = [n for n, w in rest.items() if Fraction(left * w, sum(rest.values())) >= children[n][0]]
        if not over:
            break
        full.add(min(over, key=lambda n: (Fraction(*children[n]), n)))
    shares = {n: children[n][0] for n in full}
    for n, w in rest.items():
        shares[n] = left * w // sum(rest.values())
    for n in sorted(rest)[:budget - sum(shares.values())]:
        shares[n] += 1
    return shares


def test_budgets_go_to_siblings_before_ancestors(spark):
    leaves = [("d0", "en", "src0", 10), ("d0", "en", "src4", 500), ("d0", "de", "src4", 40), ("d1", "en", "src1", 30),
              ("d1", "fr", "src1", 7), ("d2", "es", "src2", 1), ("other", "", "", 900)]
    df = spark.createDataFrame(leaves, "__domain string, __lang string, __source string, length long")
    for percent, epochs in ((60, 2), (10, 1), (100, 1), (150, 2), (0, 1)):
        got = {tuple(r)[:3]: r.budget for r in mixing.leaf_budgets(df, percent, epochs).collect()}
        want, weights = {}, (mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, mixing.SOURCE_WEIGHTS)

        def go(prefix, budget):
            depth = len(prefix)
            if depth == 3:
                want[prefix] = budget
                return
            own = [x for x in leaves if x[:depth] == prefix]
            names = {x[depth] for x in own}
            shares = deal(budget, {n: (sum(x[3] for x in own if x[depth] == n) * epochs,
                                       weights[depth].get(n, 1)) for n in names})
            for n, b in shares.items():
                go((*prefix, n), b)

        go((), sum(x[3] for x in leaves) * percent // 100)
        assert got == want
        assert sum(got.values()) == sum(x[3] for x in leaves) * percent // 100


def test_prefixes_meet_the_budgets(docs):
    rows = mixing.digests(docs).collect()
    budgets = mixing.leaf_budgets(mixing._in_tree(docs).groupBy(*mixing.LEVELS).agg(
        F.sum("__tokens").alias("length")))
    want = {tuple(r)[:3]: r.budget for r in budgets.collect() if r.budget}
    got = {}
    for r in rows:
        key = (r.domain, r.lang, r.source)
        got[key] = got.get(key, 0) + r.taken
    assert {k: v for k, v in got.items() if v} == want


def test_mixing_odd_rows(odd, spark):
    rows = mixing.selected(odd, percent=100, epochs=1)
    assert rows.select(*odd.columns).columns == odd.columns
    assert sum(r["__taken"] for r in rows.collect()) == mixing._in_tree(odd).agg(F.sum("__tokens")).head()[0]
    assert mixing.selected(odd.limit(0)).count() == 0
    twice = odd.unionByName(odd).filter("doc_id = 10")
    assert mixing.selected(twice, percent=50, epochs=1).count() == 2


def test_weights_and_budgets_are_checked(docs):
    with pytest.raises(ValueError):
        mixing.selected(docs, percent=300)
    with pytest.raises(ValueError):
        mixing.selected(docs, weights=({"d0": 0}, {}, {}))


def test_mixing_runs_no_python(spark, docs):
    plan = mixing.digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def test_long_texts_first_in_hash_order_cost_no_other_row_its_place(spark):
    ids = [i for i in range(300) if not common.held_out(i)]
    order = [r.id for r in spark.createDataFrame([(i,) for i in ids], "id long").orderBy(
        F.xxhash64("id"), "id").collect()]
    long = {order[0]: 5_000, order[1]: 900, order[2]: 900}
    rows = [(i, "x" * long[i] if i in long else "bad" if i % 2 else "good") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    got = common.labelled_sample(docs, marks, ["toxic"], 1_000, 1_700)
    assert len(got) == len(ids) - 2 and {y for _, y in got} == {0, 1}
    assert sum(len(t) for t, _ in got) <= 1_700
    assert toxicity.learn(docs, marks, chars=1_700).bias is not None


def test_a_kind_of_label_that_is_missing_in_the_sample_is_told(spark):
    ids = [i for i in range(60) if not common.held_out(i)]
    docs = spark.createDataFrame(
        [(i, "bad " * 1_000 if i % 2 else "good") for i in ids], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2, 1) for i in ids], "doc_id long, toxic int, quality int")
    with pytest.warns(UserWarning, match="one value of toxic"):
        got = common.labelled_sample(docs, marks, ["toxic", "quality"], 1_000, 2_000)
    assert {y for _, y, _ in got} == {0}
    with pytest.warns(UserWarning, match="sample of 0 rows"):
        common.labelled_sample(docs, marks, ["toxic"], 1_000, 3)


def test_lines_far_down_a_text_are_learnt_from():
    plain = "".join(f"Some plain words stand in line {i}.\n" for i in range(140))
    poor = "".join(plain.splitlines(True)[:80]) + "$ | $ |\n" * 60
    field = crf_lines.fit([(plain, 1), (poor, 0)] * 5)
    tail = crf_lines.line_features(crf_lines.visible_lines("$ | $ |\n" * 20))
    assert not field.labels(tail).any()
    assert crf_lines.judge(plain, field)[-2] == 1.0


def test_bound_of_the_toxicity_sample():
    assert toxicity.SAMPLE_CHARS == 30_000_000
