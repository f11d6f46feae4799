"""Strings of JSON at any depth, against a walk."""

import json
import random
import re

from quillspark.operators import nested

BODIES = ['"root"', '{"a": ["x", 1, null, true, {"b c": "y", "q\\"\\\\": "z"}], "d": {"e": {"f": [["deep"]]}}, "": "empty"}', "{", "[]", "{}", "7", "null", "", '{"a": "1", "a": "2"}', '["é🎉", "", "12"]', None]


def walk(value, path="$"):
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, dict):
        for k, v in value.items():
            name = k if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", k) else '"' + k.replace("\\", "\\\\").replace('"', '\\"') + '"'
            yield from walk(v, f"{path}.{name}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, f"{path}[{i}]")


def test_strings_are_those_of_a_walk(spark):
    rnd = random.Random(2)
    make = lambda d: rnd.choice([rnd.choice(["s", "t u", ""]), rnd.randrange(9), None]) if d == 0 else rnd.choice([[make(d - 1) for _ in range(rnd.randrange(4))], {rnd.choice("abcd"): make(d - 1) for _ in range(3)}])
    bodies = BODIES + [json.dumps(make(rnd.randrange(6))) for _ in range(40)]
    docs = spark.createDataFrame([(i, b, "p") for i, b in enumerate(bodies)], "id long, body string, path string")
    got = sorted(tuple(r) for r in nested.strings(docs).collect())
    bad = {r.id for r in nested.bad(docs).collect()}
    assert bad == {2, 7, 8}
    assert got == sorted((i, p, v) for i, b in enumerate(bodies) if b is not None and i not in bad for p, v in walk(json.loads(b)))
    assert nested.strings(docs.where("false")).count() == 0
