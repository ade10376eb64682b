"""Forms for large tables equal the short ones: contained needles, ranges, circles, chained answers."""

import random

import pytest
from pyspark.sql import functions as F

from stemma.operators import classify, contains, coverage, graph, resolve


@pytest.mark.parametrize("seed", [1, 2])
def test_contained_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    texts = [word(rng.randint(0, 12)) for _ in range(150)] + [None, "", "aaaaaaa", "日本語"]
    needles = [word(rng.randint(0, 6)) for _ in range(80)] + [None, "", "a", "ab", "日", "longer than every text of all"]
    got = contains.contained(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), spark.createDataFrame([(n,) for n in needles], "needle string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted({(t, n) for t in texts for n in needles if t is not None and n and n in t})
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert contains.contained(got.select("text"), got.select("needle").where("false")).count() == 0


def test_regions_and_parishes_by_index_equal_the_broadcast_ones(spark):
    rng = random.Random(3)
    names = ["agres", "ibi", "vila", "ont", "fontanars", "a", ""]
    places = [(rng.choice(["agres", "Ibi de dalt", "", None, "ontinyent", "vila-sacra"]), rng.choice(["Àgres, Alacant", "IBI", None, "", "x", "La Vila"])) for _ in range(60)]
    df = spark.createDataFrame(places, "town string, place string")
    for rules in (names[:-1], names, []):
        towns = spark.createDataFrame([(f"r{i}", i, n) for i, n in enumerate(rules)], "region string, ord int, needle string")
        needles = spark.createDataFrame([(f"f{i}", i, n) for i, n in enumerate(reversed(rules))], "region string, ord int, needle string")
        short, long = (sorted(map(str, classify.region(df, towns, needles, many=m).collect())) for m in (False, True))
        assert short == long
    asked = spark.createDataFrame([(p,) for p in ["Ontinyent, València", "Fontanars dels Alforins", "", None, "res", "font", "Moixent i Agres", "zzz"]], "place string")
    by_table = coverage.parish_key(asked, spark, names=coverage.parishes(spark))
    assert sorted(map(str, by_table.collect())) == sorted(map(str, coverage.parish_key(asked, spark).collect()))


def test_verdicts_by_a_table_equal_those_by_the_code(spark):
    rng = random.Random(5)
    code = tuple((f"p{k}", s, tuple(sorted((a := rng.randint(1500, 1900), a + rng.choice([0, 3, 40, 200])) for _ in range(rng.randint(0, 5))))) for k in range(6) for s in ("bateig", "matrimoni", "defuncio"))
    asked = [(i, rng.choice([None, "else", *(f"p{k}" for k in range(6))]), rng.choice(["bateig", "matrimoni", "defuncio"]), rng.choice([None, *range(1480, 2030)])) for i in range(800)]
    lookups = spark.createDataFrame(asked, "id int, parish string, sacrament string, year int").repartition(4)
    short = coverage.verdicts(lookups, spark, coverage=code)
    long = coverage.verdicts(lookups, spark, spans=coverage.ranges(spark, code))
    # Where two ranges of one distance have the same place in their lists, either may be named.
    key = lambda df: sorted(map(str, df.drop("nearest_from", "nearest_to").collect()))
    assert key(long) == key(short)
    assert {(r.parish, r.sacrament, r.nearest_from, r.nearest_to) for r in long.where("nearest_from IS NOT NULL").collect()} <= {(p, s, a, b) for p, s, spans in code for a, b in spans}
    assert len({r.why for r in long.collect()}) == 7


def above(edges, start, known):
    seen, front = set(), [start]
    while front:
        front = [p for x in front for c, p in edges if c == x and p not in known and p not in seen and not seen.add(p)]
    return seen - {start}


@pytest.mark.parametrize("seed", [3])
def test_upstream_counts_over_circles(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(45 * seed)} | {(n + k, n + k + 1) for k in range(12)} | {(5, 5)}
    known = {k for k in range(n) if rng.random() < 0.1}
    years = {k: rng.choice([None, *range(1700, 1800)]) for k in range(n + 13)}
    e = spark.createDataFrame(list(edges), "child int, parent int")
    everybody = spark.createDataFrame([(k,) for k in range(n + 20)], "person int")
    got = graph.upstream_counts(e, everybody, spark.createDataFrame(list(years.items()), "person int, year int"), spark.createDataFrame([(k,) for k in known], "person int"))
    want = {}
    for k in range(n + 20):
        if found := above(edges, k, known):
            want[k] = (len(found), min((years[x] for x in found if years.get(x) is not None), default=None))
    assert {r.start: (r.upstream, r.oldest) for r in got.collect()} == want
    circles = {}
    for r in graph.strong_components(e).collect():
        circles.setdefault(r.circle, set()).add(r.person)
    reach = {k: above(edges, k, ()) for k in range(n + 20)}
    real = {frozenset({k} | {x for x in reach[k] if k in reach[x]}) for k in reach}
    assert {frozenset(c) for c in circles.values()} == {c for c in real if len(c) > 1} and all(min(c) == k for k, c in circles.items())


@pytest.mark.parametrize("seed", [1])
def test_assignment_by_tiers_equals_that_over_all_pairs(spark, seed):
    rng = random.Random(seed)
    pairs = {(a, b): (a, b, round(rng.choice([7.5, 6.0, 5.0, 4.5, 4.5, 3.0, 2.0, 0.5]) + (0.25 if b % 5 == 0 else 0), 2), rng.randint(0, 2), 100 - b) for a in range(40) for b in range(30) if rng.random() < 0.4 and a != 7}
    schema = "l_id int, r_id int, total double, part_pos int, r_ord int"
    every = spark.createDataFrame(list(pairs.values()), schema).cache()
    left = spark.createDataFrame([(a, (a * 17) % 40) for a in range(42)], "l_id int, l_ord int")
    asked = []

    def tier(low, high):
        def draw(lefts):
            asked.append((low, {r.l_id for r in lefts.collect()}))
            return every.where((F.col("total") > low) & (F.col("total") <= high)).join(lefts, "l_id").select(*every.columns)

        return draw, low

    rows = lambda df: sorted(map(str, df.select("l_id", "top", "best", "best_total", "runner_total", "gap", "lost_to", "bucket").collect()))
    bounds = [9.0, 5.5, 4.4, 2.5, -1.0]
    got = resolve.assign_by_tiers(left, [tier(b, a) for a, b in zip(bounds, bounds[1:], strict=False)])
    assert rows(got) == rows(resolve.assign(left, every))
    # All lefts draw what scores enough, and only some draw on.
    assert all(len(who) == 42 for low, who in asked if low >= 4.4) and all(len(who) < 42 for low, who in asked if low < 4.4)


def chained_by_hand(answers, root, rounds, most, generation):
    """The serial procedure: an answer after another, the richer record kept, later parents in place of earlier ones."""
    people, father, couples, asked = {}, {}, set(), []
    level, queue = [root], []
    for turn in range(rounds):
        queue = [] if turn == 0 else queue
        ask = level if turn == 0 else [p for p in level if p not in asked]
        ask = list(dict.fromkeys(ask))
        room = len(ask) if most is None or turn == 0 else max(0, most + 1 - len(asked))
        skipped = ask[room:]
        level = []
        for pid in ask[:room]:
            asked.append(pid)
            number = {}
            for p, sosa, date in answers.get(pid, []):
                if p not in people or (not people[p] and date):
                    people[p] = date
                number[sosa] = p
            for sosa, child in number.items():
                if sosa.isdigit():
                    f, m = number.get(str(2 * int(sosa))), number.get(str(2 * int(sosa) + 1))
                    if f:
                        father[child, 0] = f
                    if m:
                        father[child, 1] = m
                    if f and m:
                        couples.add((f, m))
                elif sosa[:-2] in number:
                    couples.add((number[sosa[:-2]], child))
            level += [number[s] for s in sorted((s for s in number if s.isdigit()), key=int) if 1 << (generation - 1) <= int(s) < 1 << generation]
        queue += skipped
        if not ask[:room]:
            break
    return people, father, couples, asked, set(queue)


@pytest.mark.parametrize(("rounds", "most"), [(1, 40), (4, None), (4, 3)])
def test_chained_answers_equal_the_serial_procedure(spark, rounds, most):
    rng = random.Random(6)
    answers = {}
    for k in range(60):
        if k % 13 == 12:
            continue
        rows = []
        for n in range(1, 8):
            if rng.random() < 0.85:
                # The same person under two numbers, and circles, both occur.
                rows.append((f"P{(k * n + n // 2) % 60 if n > 1 else k}", str(n), rng.choice([None, "", f"{1700 + n}"])))
        rows += [(f"S{k}", "1-S", None), (f"Q{k}", "x", "1700"), (f"T{k}", "99-S", None)]
        answers[f"P{k}"] = rows
    df = spark.createDataFrame([(r, p, s, d) for r, rows in answers.items() for p, s, d in rows], "root string, pid string, sosa string, birth_date string").repartition(3)
    got = graph.chained(df, "P1", rounds, most, generation=3)
    # Within one answer records come by their numbers, those without one last.
    order = lambda r: (not r[1].split("-")[0].isdigit(), int(r[1].split("-")[0]) if r[1].split("-")[0].isdigit() else 0, r[1])
    people, parents, couples, asked, skipped = chained_by_hand({k: sorted(v, key=order) for k, v in answers.items()}, "P1", rounds, most, 3)
    assert [r.root for r in got["calls"].orderBy("call").collect()] == asked
    assert {r.pid: r.birth_date or None for r in got["people"].collect()} == {k: v or None for k, v in people.items()}
    assert {(r.child, r.role): r.parent for r in got["edges"].collect()} == parents
    assert {tuple(r) for r in got["couples"].collect()} == couples
    assert {r.pid for r in got["skipped"].collect()} >= skipped and (most is not None or got["skipped"].where(F.col("pid").isNotNull()).count() == 0)
