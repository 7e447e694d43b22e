"""Goldens of scores, gates, rules and the state machine."""

import pytest
from pyspark.sql import functions as F

from kinlink import config
from kinlink.operators import decide, rows, signals


def pairs(spark, *cases):
    schema = f"source_key string, handle string, ord int, signals array<{signals.SIGNAL}>"
    data = [(str(i), "c", 0, [(n, f, True, 0.9, float(p), s, {k: "true" for k in d}) for n, f, p, s, *d in case]) for i, case in enumerate(cases)]
    return decide.evaluated(spark.createDataFrame(data, schema))


NAME, IMAGE, SOCIAL, TEXT = ("username", "name"), ("profile_image", "image"), ("shared_socials", "social"), ("content", "content")
LINK, COUNTRY, DISPLAY = ("cross_link", "link"), ("country", "country"), ("display_name", "name")


def test_gates(spark):
    cases = [
        ([(*NAME, 15, "supporting"), (*COUNTRY, 2, "weak"), (*IMAGE, -6, "negative")], {"REVIEW", "NO_MATCH"}),
        ([(*NAME, 3, "weak"), (*IMAGE, 20, "strong"), (*SOCIAL, 33, "strong"), (*TEXT, 4, "supporting")], {"MATCH"}),
        ([(*NAME, 15, "supporting"), (*DISPLAY, 10, "supporting"), (*COUNTRY, 2, "weak"), (*TEXT, 1, "weak")], {"REVIEW", "NO_MATCH"}),
        ([(*NAME, 15, "supporting"), (*IMAGE, 20, "strong"), (*COUNTRY, 2, "weak")], {"MATCH"}),
        ([(*IMAGE, 20, "strong")], {"REVIEW"}),
        ([(*LINK, 30, "strong"), (*NAME, 8, "supporting")], {"MATCH"}),
        ([(*LINK, 45, "strong", "forward", "backward")], {"MATCH"}),
        ([(*LINK, -40, "conflict"), (*IMAGE, 20, "strong"), (*NAME, 15, "supporting")], {"REVIEW"}),
        ([(*LINK, -40, "conflict"), (*NAME, 15, "supporting"), (*DISPLAY, 10, "supporting")], {"NO_MATCH"}),
        ([(*TEXT, 1.5, "weak"), (*COUNTRY, 2, "weak")], {"NO_MATCH"}),
        ([(*NAME, 0, "none"), (*SOCIAL, 25, "strong"), (*IMAGE, 20, "strong")], {"MATCH"}),
    ]
    found = {int(r.source_key): r for r in pairs(spark, *[c for c, _ in cases]).collect()}
    for i, (_, wanted) in enumerate(cases):
        assert found[i].decision in wanted, (i, found[i])
        if "MATCH" not in wanted:
            assert found[i].confidence < 90


def test_points_are_capped_and_confidence_grows(spark):
    assert pairs(spark, [(*NAME, 15, "supporting"), (*DISPLAY, 10, "supporting")]).first().points == 20.0
    c = [r.c for r in spark.range(-5, 200, 5).select(decide.confidence(F.col("id").cast("double"), config.Scoring()).alias("c")).collect()]
    assert c == sorted(c) and c[0] == 0.0 and c[1] == 0.0 and c[-1] <= 100


def test_two_matches_are_ambiguous(spark):
    df = spark.createDataFrame([("a", "x", 0, "MATCH", 95.0, 50.0), ("a", "y", 1, "MATCH", 96.0, 51.0), ("b", "x", 0, "MATCH", 95.0, 50.0), ("c", "z", 0, "NO_MATCH", 5.0, 1.0)], "source_key string, handle string, ord int, decision string, confidence double, points double")
    found = {r.source_key: (r.decision, r.best) for r in decide.aggregated(df).collect()}
    assert found == {"a": ("REVIEW", "y"), "b": ("MATCH", "x"), "c": ("NO_MATCH", "z")}


def test_rules(spark):
    schema = "source_key string, handle string, place int, decision string, confidence double, hits array<string>, problems array<string>, rejected boolean"
    name, picture = config.RULES[0], config.RULES[1]
    data = [
        ("one", "a", 1, "NO_MATCH", 0.0, [name], [], False),
        ("doubt", "a", 1, "NO_MATCH", 0.0, [name], ["language"], False),
        ("both", "a", 1, "NO_MATCH", 0.0, [name, picture], ["language"], False),
        ("linked", "a", 1, "NO_MATCH", 0.0, [name, picture], ["linked elsewhere"], False),
        ("tie", "a", 1, "NO_MATCH", 0.0, [picture], [], False), ("tie", "b", 2, "NO_MATCH", 0.0, [picture], [], False),
        ("better", "a", 1, "NO_MATCH", 0.0, [picture], [], False), ("better", "b", 2, "NO_MATCH", 0.0, [name, picture], [], False),
        ("near", "a", 1, "REVIEW", 80.0, [], [], False), ("near", "b", 2, "MATCH", 92.0, [], [], False),
        ("none", "a", 1, "NO_MATCH", 10.0, [], [], False), ("gone", "a", 1, "MATCH", 99.0, [name], [], True), ("gone", "b", 2, "NO_MATCH", 1.0, [], [], False),
    ]
    df = spark.createDataFrame(data, schema)
    found = {r.source_key: (r.decision, r.target) for r in decide.ruled(df.repartition(3)).collect()}
    assert found == {
        "one": ("MATCH", "a"), "doubt": ("REVIEW", "a"), "both": ("MATCH", "a"), "linked": ("REVIEW", "a"), "tie": ("REVIEW", "a"),
        "better": ("MATCH", "b"), "near": ("REVIEW", "b"), "none": ("NO_MATCH", None), "gone": ("NO_MATCH", None),
    }


def test_verdicts(spark):
    schema = "source_key string, handle string, place int, decision string, confidence double"
    df = spark.createDataFrame([("a", "x", 1, "MATCH", 95.0), ("a", "y", 2, "REVIEW", 80.0), ("b", "x", 1, "MATCH", 95.0), ("c", "x", 1, "REVIEW", 70.0)], schema)
    v = spark.createDataFrame([("a", "x", "REJECTED", 1), ("b", "x", "REJECTED", 1), ("b", "x", "CONFIRMED", 2)], "source_key string, target_key string, verdict string, updated_at int")
    found = {r.source_key: (r.decision, r.target, r.confidence) for r in decide.reviewed(decide.overlaid(df, decide.latest_verdicts(v))).collect()}
    assert found == {"a": ("REVIEW", "y", 80.0), "b": ("MATCH", "x", 100.0)}


ROW = "source_platform string, source_status string, decision string, target_status string, matched_id string, existing_destination string, existing_remarks string"


def test_every_state(spark):
    data = [(p, s, d, t, "Id" if w else None, None, None) for (p, s, d, t), (_, w) in config.STATES.items()]
    found = rows.transitions(spark.createDataFrame(data, ROW)).collect()
    assert {r.state_case for r in found} == {c for c, _ in config.STATES.values()}
    for r in found:
        assert (r.destination == "Id") == r.write_destination
    by = {r.state_case: r.remarks for r in found}
    assert by["KICK_A"] is None and by["KICK_B"] == "no twitch id found" and by["KICK_C"] == "no kick channel found" and by["KICK_D"] == "no Id on both platforms" and by["TWITCH_B"] == "no kick id"


def test_unknown_state_raises(spark):
    with pytest.raises(Exception, match="undefined state"):
        rows.transitions(spark.createDataFrame([("kick", "EXISTS", "ODD", None, None, None, None)], ROW)).collect()


def test_policies_and_remarks(spark):
    a = ("kick", "EXISTS", "MATCH", None, "New")
    data = [(*a, "Old", None), (*a, "None", "no kick id"), (*a, None, "mine"), ("kick", "EXISTS", "NO_MATCH", None, None, "None", "mine"), ("kick", "EXISTS", "NO_MATCH", None, None, "Old", "nearest possible channel")]
    kept = rows.transitions(spark.createDataFrame(data, ROW)).collect()
    assert [(r.status, r.destination, r.write_destination, r.write_remarks) for r in kept] == [("PRESERVED", None, False, False), ("MATCH", "New", True, True), ("MATCH", "New", True, False), ("NO_MATCH", None, True, False), ("PRESERVED", None, False, True)]
    over = rows.transitions(spark.createDataFrame(data[:1], ROW), "overwrite").first()
    assert (over.status, over.destination, over.write_destination) == ("MATCH", "New", True)
