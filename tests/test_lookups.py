"""Lookups with a fake service: each key asked for once, none in a second run, negative answers kept, failures not; rate, pause and budget."""

import json

from pyspark.sql import functions as F

from lectern.operators import registry
from lectern.plans import document
from lectern.sources import lookups
from lectern.sources.adapters import Budget, Options, Retry

KNOWN = {"university of alder": {"org_id": "r1", "display_name": "University of Alder", "names": [], "types": ["funder"], "fundref": "77"}}


def service(log, failing=()):
    """Answers from KNOWN and notes each key it was asked for."""

    def call(key):
        with open(log, "a") as f:
            f.write(key + "\n")
        if key in failing:
            return failing[key], None
        return 200, {"found": KNOWN.get(key)}

    return call


def client(log, failing=(), **more):
    return lookups.Client(service(log, failing), lambda answer: answer["found"], Retry(attempts=2, waits=(0.0,)), per_second=1e6, **more)


def asked(log):
    try:
        return sorted(open(log).read().split("\n")[:-1])
    except FileNotFoundError:
        return []


def test_second_run_asks_nothing(spark, tmp_path):
    log, cache = str(tmp_path / "log"), lookups.Cache(str(tmp_path / "cache"))
    names = ["University of Alder", "UNIVERSITY of  Alder", "Nobody", "Down", "Bad", None, " ", "Nobody"]
    df = spark.createDataFrame([(i, n, "clash") for i, n in enumerate(names)], "i int, name string, key string")
    got = {r.i: r.answer for r in lookups.looked_up(df, "name", client(log, {"down": 503, "bad": 404}, pause=0.0), cache).collect()}
    assert json.loads(got[0]) == json.loads(got[1]) == KNOWN["university of alder"] and {got[i] for i in range(2, 8)} == {None}
    assert asked(log) == ["bad", "down", "down", "nobody", "university of alder"]  # a refusal is not repeated, a failure is
    again = {r.i: r.answer for r in lookups.looked_up(df, "name", client(log, {"down": 503, "bad": 404}, pause=0.0), cache).collect()}
    assert again == got and asked(log)[5:] and asked(log).count("nobody") == asked(log).count("university of alder") == 1
    before = asked(log)
    last = lookups.looked_up(df.where("name not in ('Down', 'Bad')"), "name", client(log), cache)
    assert last.where("answer is not null").count() == 2 and asked(log) == before
    assert cache.read(spark).count() == 2  # of them one that says that nothing is known
    cache.add(spark.createDataFrame([("nobody", '{"org_id": "r9"}')], "key string, answer string"))
    assert {r.key: r.answer for r in cache.read(spark).collect()}["nobody"] == '{"org_id": "r9"}' and cache.read(spark).count() == 2
    assert lookups.looked_up(df.limit(0), "name", client(log), cache).count() == 0 and asked(log) == before


def test_pause_after_a_failure(spark, tmp_path):
    log, cache = str(tmp_path / "log"), lookups.Cache(str(tmp_path / "cache"))
    df = spark.createDataFrame([(f"k{i}",) for i in range(20)], "name string")
    every = {f"k{i}": 503 for i in range(20)}
    assert lookups.looked_up(df, "name", client(log, every, pause=1000.0), cache).where("answer is not null").count() == 0
    assert len(asked(log)) == 2 and len(set(asked(log))) == 1  # two attempts for the first key, none for the others
    assert cache.read(spark).count() == 0


def test_rate_and_budget():
    """Two tasks of four calls a second: half a second between the calls of one."""
    clock, slept, calls = [0.0], [], []

    def sleep(seconds):
        slept.append(seconds)
        clock[0] += seconds

    def call(key):
        calls.append((key, clock[0]))
        return (503 if key == "b" else 200), {}

    c = lookups.Client(call, retry=Retry(attempts=3, waits=(1.0, 2.0), budget=2.5), per_second=4.0, tasks=2, pause=0.0, sleep=sleep, clock=lambda: clock[0])

    class Keys:
        """Runs the task's function in place."""

        def select(self, *_):
            return self

        repartition = select

        def mapInPandas(self, f, _):  # noqa: N802
            import pandas as pd

            return pd.concat(f(iter([pd.DataFrame({"key": ["a", "b"]}), pd.DataFrame({"key": ["b", "b", "c"]})])))

    got = c.answers(Keys())
    assert got.ok.tolist() == [True, False, False, False, True]
    times = [t for _, t in calls]
    assert all(b - a >= 0.5 - 1e-9 for a, b in zip(times, times[1:]))
    assert [k for k, _ in calls] == ["a", "b", "b", "b", "b", "b", "c"]  # a retry of a second each for two of them; half a second is left for the third
    b = Budget(2.5)
    assert Retry(budget=2.5).run(lambda: (500, None), b, lambda s: None) == (500, None) and b.seconds == 1.5
    assert Retry().get(lambda: (200, 7)) == 7 and Retry().get(lambda: (404, 7)) is None


def test_records_with_lookups(spark, tmp_path):
    log, cache = str(tmp_path / "log"), lookups.Cache(str(tmp_path / "cache"))
    response = {"titles": [{"title": "Boats"}], "creators": [{"name": "Lima, Ana", "affiliation": ["University of Alder, Norway"]}, {"name": "Roe, Max", "affiliation": ["Nowhere"]}], "fundingReferences": [{"funderName": "The University of Alder"}], "content": {"sections": [{"sectionTitle": "A", "sectionContent": "Some text of it."}]}}
    docs = spark.createDataFrame([(1, "Boats\nAna Lima\nUniversity of Alder, Norway\n## A\nSome text of it.")], "doc_id long, text string")
    options = Options(structurer=lambda d: d.select("doc_id", F.lit(json.dumps(response)).alias("response")), lookups=lookups.organisations(client(log), cache), ground_headers=False)
    r = document.documents(docs, options).first()
    assert [a.affiliationIdentifier for c in r.creators for a in c.affiliation] == ["r1", None]
    assert r.funding[0].funderIdentifier == "https://doi.org/10.13039/77"
    assert asked(log) == sorted(["nowhere", "the university of alder", "university of alder", "university of alder, norway"])
    document.documents(docs, options).first()
    assert len(asked(log)) == 4


def test_names_that_share_popular_words_make_no_pairs(spark):
    """Names of popular words only: what is paired for comparison follows the matches, not the products of a word's names (before: 200 x 200 pairs and more)."""
    words = ["alder", "birch", "cedar", "dogwood", "elm", "fir", "gorse", "hazel"]
    names = [" ".join(words[(i // 8**k) % 8] for k in range(4)) + f" {words[i % 8]}x{i % 5}" for i in range(400)]
    orgs = spark.createDataFrame([(f"o{i:03}", n, []) for i, n in enumerate(names)], "org_id string, display_name string, names array<string>")
    asked = spark.createDataFrame([(" ".join(reversed(n.split())),) for n in names] + [("the " + names[7] + " of it",), ("alder",)], "name string")
    got = registry.matches(asked, orgs)
    rows = {r.name: r for r in got.collect()}
    assert set(rows) == {r.name for r in asked.collect()} - {"alder"}
    want = {}
    for i, n in enumerate(names):
        want.setdefault(" ".join(sorted(set(n.split()))), f"o{i:03}")
    assert all(r.org_id == want[" ".join(sorted(set(k.split())))] for k, r in rows.items() if not r.phrase)
    assert rows["the " + names[7] + " of it"].phrase
    pairs = registry.candidates(asked, orgs)[0].count()
    assert pairs < 10 * len(names), pairs
