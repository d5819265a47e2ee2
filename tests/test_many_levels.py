"""Variables of many levels: code tables stay on the cluster, the driver gets rows by the level nowhere but in the model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from softlattice.functions.formula import Formula
from softlattice.operators import impact, layout, objective, reduce, schema, score
from softlattice.plans import optim
from softlattice.plans.train import _summed, train_plus
from softlattice.queries import QUERIES


@pytest.fixture
def collected(spark, monkeypatch):
    """The number of rows of each collect()."""
    kind, seen = type(spark.range(0)), []
    monkeypatch.setattr(kind, "collect", lambda self, f=kind.collect: seen.append(len(out := f(self))) or out)
    return seen


def events(spark, path, users=3000):
    """Each user has a favourite of three outcomes, and every other one now and then."""
    user, n = F.col("id") % users, F.floor(F.col("id") / users)
    kind = F.concat(F.lit("e"), F.when(n < 4, user % 3).otherwise((user + n) % 3))
    spark.range(users * 6).select("id", user.alias("user_id"), kind.alias("event_type")).withColumnRenamed("id", "event_id").write.parquet(f"{path}/events.parquet")
    return spark.read.parquet(f"{path}/events.parquet")


def test_recoding_collects_no_levels(spark, tmp_path, collected):
    events(spark, tmp_path)
    got = QUERIES["impact_recode"](spark, str(tmp_path))
    assert max(collected) <= 30
    assert got.where("kind = 'CategoricalVectorEnc'").count() >= 3 * 7 and got.where("kind = 'Const'").count() == 1


def test_code_tables_are_the_collected_codes(spark):
    rows = [(f"l{i % 7}", f"m{i % 5}", "p" if (i * 7) % 11 < 4 + i % 6 else "q" if i % 3 else "r") for i in range(400)]
    df = spark.createDataFrame(rows, "v string, u string, y string")
    f = Formula.parse("y ~ v + u")
    s = schema.schema_scan(df, f)
    plain = layout.make_layout(f, s)
    effect = impact.effect_table(spark, plain, [0.01 * i for i in range(plain.dims)])
    for e in (None, effect):
        stats = impact.impact_stats(df, plain, ["v", "u"])
        held = impact.collect_codes(impact.impact_code_filter(impact.impact_codes(stats, e)), plain.outcomes)
        tables = impact.code_tables(stats, plain.outcomes, e)
        assert {v: names for v, (names, _) in tables.items()} == {v: names for v, (names, _) in held.items()}
        for v, (_, t) in tables.items():
            got = {r["level"]: r["codes"] for r in t.collect()}
            assert got.keys() == held[v][1].keys() and all(np.allclose(got[k], held[v][1][k], atol=1e-9) for k in got)
    # Encoded, scored and told as effects they are the same too.
    a, b = layout.make_layout(f, s, held), layout.make_layout(f, s, tables)
    x = [((i * 5) % 17 - 8) / 40 for i in range(a.dims)]
    for read in (lambda lay: layout.encode(df, lay).select("num"), lambda lay: score.predict(df, lay, x).select("_p")):
        assert np.allclose(*(sorted(r[0] for r in read(lay).collect()) for lay in (a, b)), atol=1e-9)
    told = [sorted(tuple(r) for r in impact.effect_table(spark, lay, x).collect()) for lay in (a, b)]
    assert [r[:3] for r in told[0]] == [r[:3] for r in told[1]] and np.allclose([r[3] for r in told[0]], [r[3] for r in told[1]], atol=1e-9)
    with pytest.raises(ValueError):
        layout.effects(b, x)


def test_schema_without_the_levels_of_wide_variables(spark):
    df = spark.createDataFrame([(str(i), f"k{i % 4}", "p" if i % 3 else "q") for i in range(60)], "v string, u string, y string")
    f = Formula.parse("y ~ ^v + u")
    assert schema.schema_scan(df, f, 10).levels == {"u": ("k0", "k1", "k2", "k3"), "v": ()} and schema.schema_scan(df, f, 60) == schema.schema_scan(df, f)


def test_training_collects_no_levels(spark, tmp_path, collected):
    """The levels and their effects come once, as one Arrow table; Newton's steps, statistics and codes collect a few rows each."""
    df = events(spark, tmp_path)
    m = train_plus(df, "event_type ~ ^user_id", max_levels=40, passes=2, max_rounds=8)
    assert max(collected) <= 30
    assert len(m.layout.slots[-1].names) == 3000 and list(m.layout.slots[-1].names) == sorted(map(str, range(3000)))
    got = score.accuracy(score.score(df, m.layout, m.x), m.layout).first()
    assert got["n"] == 18_000 and got["n_right"] >= 0.95 * 12_000  # each user has its favourite four times in six


def test_rows_that_are_summed_give_the_same_fit(spark):
    """Equal rows as one with the sum of their weights: blank, null, unknown and weightless rows count as before."""
    rows = [(f"l{i % 9}" if i % 17 else None, f"m{i % 4}" if i % 13 else " ", "p" if (i * 7) % 11 < 5 else "q" if i % 5 else None, ("1", "2.5", "x", "0", "-1", None)[i % 6]) for i in range(500)]
    df = spark.createDataFrame(rows, "v string, u string, y string, w string")
    f = Formula.parse("y ~ v + u")
    s = schema.schema_scan(df, f)
    lay = layout.make_layout(f, s)
    x = np.linspace(-0.3, 0.4, lay.dims)
    few, w, n = _summed(df, f, s, "w")
    assert n == few.count() < 80
    a, b = (objective.DataObjective(layout.encode(d, lay, c), lay)(x) for d, c in ((df, "w"), (few, w)))
    assert abs(a.f - b.f) < 1e-9 and np.allclose(a.g, b.g) and np.allclose(a.h, b.h)
    key = lambda d, c: sorted(tuple(round(q, 9) if isinstance(q, float) else q for q in r) for r in impact.impact_stats(d, lay, ["v", "u"], c).collect())
    assert key(df, "w") == key(few, w)


def test_training_agrees_with_codes_on_the_driver(spark):
    """Two passes as they were done with collected codes, for a formula with a number, a narrow and a wide variable; with and without polish the levels are all there."""
    rows = [(f"l{i % 30}" if i < 890 else f"rare{i}", f"m{i % 3}", float(i % 7), None if i >= 890 else "p" if (i * 7) % 11 < 3 + i % 6 else "q") for i in range(900)]
    df = spark.createDataFrame(rows, "v string, u string, n double, y string")
    for text in ("y ~ v + u + n", "y ~ v + u"):
        f = Formula.parse(text)
        s = schema.schema_scan(df, f)
        plain, lay, x = layout.make_layout(f, s), None, None
        for _ in range(2):
            stats = impact.impact_stats(df, plain, ["v"]) if lay is None else impact.impact_stats(score.predict(df, lay, x), plain, ["v"], None, "_p")
            codes = impact.impact_codes(stats, None if lay is None else impact.effect_table(spark, lay, x))
            new = layout.make_layout(f, s, impact.collect_codes(impact.impact_code_filter(codes), plain.outcomes))
            fn = objective.SumFn(objective.DataObjective(layout.encode(df, new).persist(), new), objective.NormPenalty(new.dims, 0.01, objective.all_but_const(new)))
            best = optim.newton(fn, np.zeros(new.dims) if lay is None else np.array(impact.warm_start(lay, x, new)), 20)
            if lay is not None and best.f - old <= max(1.0, best.f) * 1e-3:
                if best.f > old:
                    lay, x = new, best.x
                break
            lay, x, old = new, best.x, best.f
        m = train_plus(df, f, strength=0.01, max_levels=10, passes=2)
        assert m.layout == plain and len(plain.slots[-1].names) == 40
        want = np.array(impact.translate(lay, x, plain))
        rows_of = lambda q: np.array([r["_p"] for r in score.predict(df, plain, q).orderBy("v", "u", "n").collect()])
        assert np.abs(rows_of(want) - rows_of(m.x)).max() < 1e-4


def test_the_last_merge_is_one_task(spark, monkeypatch):
    """Also where a setting raises the number of tasks that rows are dealt to by a key: else a part of the sum would pass for all of it."""
    kind = type(spark.range(0))
    monkeypatch.setattr(kind, "repartition", lambda self, n, *cols, f=kind.repartition: f(self, max(n, 13) if cols else n, *cols))
    total = lambda a, batch: a + sum(batch.column("id").to_pylist())
    assert reduce.reduce_parallel(spark.range(0, 1000, 1, 40), int, total, lambda a, b: a + b) == 499_500
