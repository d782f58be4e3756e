"""Conversation repair against all edit scripts, in pieces, and on odd tables."""

import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lumenline.llm import conversations as C

SHAPE = re.compile(r"(s?(ua)+)?")
PREFIX = re.compile(r"s?(ua)*u?")
SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit string"


def all_scripts(rows):
    """(cost, audit) of every script with up to two inserts before each row and at the end that gives a well-formed conversation."""
    def walk(i, roles, audit, cost):
        for more in ("", *map("".join, itertools.chain(itertools.product("ua", repeat=1), itertools.product("ua", repeat=2)))):
            now, done, paid = roles + more, audit + "I" * len(more), cost + 5 * len(more)
            if not PREFIX.fullmatch(now):
                continue
            if i == len(rows):
                if SHAPE.fullmatch(now):
                    yield paid, done
                continue
            initial, must, truncated = rows[i]
            yield from walk(i + 1, now, done + "D", paid + 2)
            if not must:
                yield from walk(i + 1, now + (initial or "-"), done + "K", paid + 5 * truncated)
                for role in "ua":
                    yield from walk(i + 1, now + role, done + "R", paid + 1 + 5 * truncated)

    return walk(0, "", "", 0)


ROWS = [(initial, must, cut) for initial in "suax" for must, cut in ((False, False), (False, True), (True, False))]


def test_cheapest_equals_all_scripts():
    dice = random.Random(3)
    cases = [(), *itertools.product(ROWS, repeat=1), *itertools.product(ROWS, repeat=2), *(dice.choices(ROWS, k=3) for _ in range(60))]
    for rows in cases:
        assert C.cheapest(rows) == min(all_scripts(rows)), rows


@pytest.mark.parametrize("piece", [1, 2, 7])
def test_pieces_change_nothing(monkeypatch, piece):
    dice = random.Random(piece)
    cases = [dice.choices(ROWS, k=dice.randrange(40)) for _ in range(300)]
    monkeypatch.setattr(C, "PIECE", 1000)
    whole = [C.cheapest(rows) for rows in cases]
    monkeypatch.setattr(C, "PIECE", piece)
    assert [C.cheapest(rows) for rows in cases] == whole


def test_long_conversation():
    rows = random.Random(1).choices(ROWS, k=50_000)
    began = time.time()
    cost, audit = C.cheapest(rows)
    assert time.time() - began < 60 and len(audit.replace("I", "")) == 50_000 and cost > 0


def test_repaired_rows():
    rows = [("system", "a."), ("assistant", "b."), ("user", ""), ("user", "c."), ("user", "d."), ("assistant", "e")]
    found = C.examined([None, 1, 4, 4, 5, 9], rows)
    assert (found["gaps"], found["blank"], found["duplicate"], found["truncated"], found["illegal"]) == (5, 1, 0, 1, 3)
    # the first assistant's row becomes the user's; the empty one goes
    assert (found["cost"], found["audit"]) == min(all_scripts([("s", 0, 0), ("a", 0, 0), ("u", 1, 0), ("u", 0, 0), ("u", 0, 0), ("a", 0, 1)]))
    assert SHAPE.fullmatch("".join(r["role"][0] for r in found["repaired"]))


def test_odd_tables(spark):
    rows = [
        (1, 0, "user", "Hi.", "", ""), (1, 1, "assistant", "Yo.", "", ""), (1, 1, "assistant", "Yo.", "", ""),
        (None, None, None, None, None, None), (None, 2, "user", "x.", "", ""), (2, 5, "", "\t\n\x0b", "", ""),
        (3, None, "user", "q?", "", ""), (3, None, "assistant", "a" * 300_000, "", ""), (4, 1, "user", "gone.", "", ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    found = C.repair(df, "conv_id", "turn", "role", "text", F.coalesce(F.col("conv_id"), F.lit(0)) != 4)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
    got = {r["conv_id"]: r for r in found.collect()}
    short = {k: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) for k, r in got.items()}
    assert short == {
        1: (0, 0, 1, 0, 1, 2, "KKD"),
        None: (0, 1, 0, 0, 1, 4, "DD"),
        2: (0, 1, 0, 0, 0, 2, "D"),
        3: (0, 0, 0, 1, 0, 4, "DD"),  # null turns are ordered by role
        4: (0, 0, 0, 0, 0, 0, ""),
    }
    assert [tuple(x) for x in got[1]["repaired"]] == [("user", "Hi."), ("assistant", "Yo.")] and got[4]["repaired"] == []
    assert C.repair(df.limit(0), "conv_id", "turn", "role", "text").count() == 0


def test_damage(spark):
    df = spark.range(400).selectExpr("id as conv_id", "1L as turn", "'system' as role", "'One. Two?' as text")
    kinds = {tuple(r) for r in C.damaged(df, "conv_id", "turn", "role", "text").select("role", "text", "dropped", "copy").distinct().collect()}
    plain = ("system", "One. Two?")
    assert kinds == {(*plain, False, 0), (*plain, True, 0), (*plain, False, 1), ("system", "", False, 0), ("system", "One Two", False, 0), ("user", "One. Two?", False, 0)}
