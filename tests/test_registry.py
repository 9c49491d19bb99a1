"""Inexact matches of names against all pairs; funders and persons by them; no popular token is joined on."""

import math
import random
import re
import unicodedata

from pyspark.sql import functions as F

from lectern.operators import registry

ORGS = "org_id string, display_name string, names array<string>, types array<string>, fundref string"


def plain_key(s):
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return " ".join(s.split()).lower()


def plain_matches(asked, orgs, alike=95):
    names = {(i, d, k) for i, d, more, *_ in orgs for k in {plain_key(x) for x in [d, *(more or [])]} if re.findall(r"[^\W_]+", k)}
    df = {}
    for *_, k in names:
        for t in set(re.findall(r"[^\W_]+", k)):
            df[t] = df.get(t, 0) + 1
    w = lambda t: math.floor(1000 * math.log(1 + len(names) / df[t])) if t in df else int(1000 * math.log(1 + len(names)))
    out = {}
    for q in set(asked):
        if q is None:
            continue
        words = re.findall(r"[^\W_]+", plain_key(q))
        found = []
        for i, d, k in names:
            own = re.findall(r"[^\W_]+", k)
            both = sum(map(w, set(words) & set(own)))
            every = sum(map(w, set(words) | set(own)))
            phrase = f" {' '.join(own)} " in f" {' '.join(words)} "
            if phrase or both * 100 >= alike * every:
                found.append((not phrase, -len(k) if phrase else 0, -both / every, i, d, phrase))
        if found:
            x = min(found)
            out[q] = (x[3], x[4], round(-x[2], 9), x[5])
    return out


def registry_rows(rng):
    places = ["Alder", "Birch", "Cedar", "Doñana", "Elm", "São Pinho", "Oak Hill"]
    orgs = [(f"o{i:03}", f"{rng.choice(['University', 'Hospital', 'Institute', 'Academy'])} of {rng.choice(places)}" + rng.choice(["", " and the Sea", " for Boats"]), rng.choice([None, [], [f"U{i % 9}"], ["The Sea Board"]]), rng.choice([["funder"], ["education"], ["education", "funder"], None]), rng.choice([None, f"10{i}"])) for i in range(60)]
    return [*orgs, ("o900", "of the", None, ["funder"], None), ("o901", "", None, None, None), ("o902", "!!", ["  "], None, None)]


def test_matches_equal_all_pairs(spark):
    rng = random.Random(12)
    orgs = registry_rows(rng)
    asked = [None, "", "of the", "the of", "nothing known", "U3", "Sea Board, The", "sao pinho university OF"]
    for _, d, *_ in orgs:
        w = d.split()
        asked += [d, d.upper(), f"Department of Nets, {d}, Norway", " ".join(rng.sample(w, len(w))), " ".join(w[:-1]), d + " Trust"]
    df = spark.createDataFrame([(a,) for a in asked], "name string").withColumns({"org_id": F.lit("clash"), "token": F.lit("clash")})
    for alike in (95, 60):
        got = {r["name"]: (r.org_id, r.org_name, round(r.score, 9), r.phrase) for r in registry.matches(df, spark.createDataFrame(orgs, ORGS), alike=alike).collect()}
        assert got == plain_matches(asked, orgs, alike) and got
    assert registry.matches(df.limit(0), spark.createDataFrame(orgs, ORGS)).count() == 0
    assert registry.matches(df, spark.createDataFrame([], ORGS)).count() == 0


def test_funders_by_inexact_names(spark):
    orgs = [("r1", "National Fund for Rivers", [], ["funder"], "501"), ("r2", "Boat Trust", ["BT"], ["funder"], None), ("r3", "University of Alder", [], ["education"], "77")]
    names = ["national fund for rivers", "the National Fund for Rivers, Norway", "Rivers Fund for National", "Boat Trust", "University of Alder", "Alder", None, "Boat  trust"]
    refs = spark.createDataFrame([(i, n, "own" if i == 7 else None, None, None) for i, n in enumerate(names)], "i int, funderName string, funderIdentifier string, funderIdentifierType string, schemeUri string")
    got = {r.i: (r.funderName, r.funderIdentifier) for r in registry.funders(refs, spark.createDataFrame(orgs, ORGS)).collect()}
    fund = ("National Fund for Rivers", "https://doi.org/10.13039/501")
    assert got == {0: fund, 1: fund, 2: fund, 3: ("Boat Trust", "r2"), 4: ("University of Alder", None), 5: ("Alder", None), 6: (None, None), 7: ("Boat  trust", "own")}


def test_persons_by_the_organisation_that_an_affiliation_is_taken_for(spark):
    orgs = spark.createDataFrame([("r3", "University of Alder", [], ["education"], None)], ORGS)
    known = spark.createDataFrame([("0001", "Ana", "Lima", ["University of Alder"]), ("0002", "Ana", "Lima", ["Elsewhere"])], "orcid string, given string, family string, orgs array<string>")
    asked = spark.createDataFrame([(1, "Ana", "Lima", ["Department of Nets, University of Alder"]), (2, "Ana", "Lima", ["University of Birch"])], "creator_id int, given string, family string, affiliations array<string>")
    assert {r.creator_id: r.orcid for r in registry.persons(asked, known, orgs=orgs).collect()} == {1: "0001", 2: None}
    assert {r.orcid for r in registry.persons(asked, known).collect()} == {None}
