"""Registries against a loop over what was done."""

import random

from tessera.operators import registry


def test_state(spark):
    rng = random.Random(8)
    ops = ["create", "register", "activate", "activate", "deactivate", "delete", "other"]
    rows = [(f"r{rng.randrange(12)}", f"a{rng.randrange(3)}", i, rng.choice(ops), rng.random()) for i in range(400)]
    held: dict = {}
    active: dict = {}
    for reg, name, _, op, score in rows:
        mine = held.setdefault(reg, {})
        if op == "create" or op == "register" and name not in mine:
            mine[name] = [1, 0.0]
        if op == "register":
            mine[name] = [mine[name][0] + 1, score]
        elif op == "activate" and name in mine:
            active[reg] = name
        elif op == "deactivate" or op == "delete" and active.get(reg) == name and name in mine:
            active[reg] = None
        if op == "delete":
            mine.pop(name, None)
    want = {(reg, name, v, s, active.get(reg) == name) for reg, mine in held.items() for name, (v, s) in mine.items()}
    df = spark.createDataFrame(rows, "g string, n string, i int, op string, score double").repartition(5)
    got = {tuple(r) for r in registry.state(df, "g", "n", "i", "op", "score").collect()}
    assert got == want and any(w[4] for w in want)
