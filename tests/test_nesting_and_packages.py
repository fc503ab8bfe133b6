import random

from corpuscle.operators import facts, imports, nesting, packages


def test_innermost_against_all_pairs(spark, monkeypatch):
    rng = random.Random(12)

    def spans(low, high, depth):
        out = []
        while low < high and rng.random() < 0.8:
            a = rng.randint(low, high)
            b = rng.randint(a, high)
            out.append((a, b))
            if depth < 5:
                out += spans(a + 1, b - 1, depth + 1)
            low = b + 1
        return out

    rows = [(k, f"{k}-{i}", a, b) for k in "abc" for i, (a, b) in enumerate(spans(0, 90, 0))] + [("d", "d-0", 5, 9)]
    points = [(k, p, f"p{p}") for k in "abcde" for p in range(-2, 95)]
    want = {}
    for k, p, _ in points:
        around = [(a, -b, name) for key, name, a, b in rows if key == k and a < p <= b]
        want[k, p] = max(around)[2] if around else None
    one = spark.createDataFrame(points, "key string, at int, label string")
    two = spark.createDataFrame(rows, "key string, name string, first int, last int")
    for cell in (1 << 17, 8):
        monkeypatch.setattr(nesting, "CELL", cell)
        got = nesting.innermost(one, two, ["key"], "at", "first", "last", ["name"]).collect()
        assert {(r.key, r["at"]): r.name for r in got} == want and len(got) == len(points)


def test_conditions_in_the_manifests_order():
    assert packages.target_of({"browser": "./b.js", "default": "./d.js", "import": "./i.js"}, packages.CONDITIONS) == "./d.js"
    assert packages.target_of({"node": {"require": "./r.cjs"}, "import": "./i.js"}, packages.CONDITIONS) == "./i.js"
    assert packages.target_of({"import": None, "default": "./d.js"}, packages.CONDITIONS) is None
    assert packages.target_of(["./a.js", "./b.js"], packages.CONDITIONS) == "./a.js"
    assert packages.parsed_manifest('{"name": "x", "exports": {"./up": "../up.js", ".": {"require": "./r.js", "import": "./i.js"}}}') == ("x", False, [("./up", None, None), (".", "./i.js", "./r.js")])
    assert packages.parsed_manifest("{") == (None, False, []) == packages.parsed_manifest('{"name": 3}')


def test_packages_of_a_workspace(spark):
    files = {
        "core/package.json": '{"name": "@me/core", "exports": {".": {"types": "./t.d.ts", "source": "./src/index.ts", "default": "./dist/index.js"}, "./feat/*": "./src/feat/*.ts", "./feat/deep/*": "./src/deep/*.js", "./feat/private/*": null, "./both": {"require": "./src/req.cjs", "import": "./src/imp.mjs"}}}',
        "plain/package.json": '{"name": "plain", "module": "lib/main.js"}', "bare/package.json": '{"name": "bare"}', "copy/plain/package.json": '{"name": "plain", "main": "other.js"}', "broken/package.json": "{",
        "core/src/index.ts": "", "core/src/feat/a.ts": "", "core/src/feat/deep/x.ts": "", "core/src/deep/x.ts": "", "core/src/feat/private/p.ts": "", "core/src/req.cjs": "", "core/src/imp.mjs": "", "core/src/hidden.ts": "", "plain/lib/main.ts": "", "plain/lib/util.ts": "", "bare/index.js": "",
        "app/a.ts": "import '@me/core'; import '@me/core/feat/a'; import '@me/core/feat/deep/x'; import '@me/core/feat/private/p'; import '@me/core/src/hidden'; import '@me/core/both'; import 'plain'; import 'plain/lib/util'; import 'bare'; import 'node:fs'; import 'left-pad';",
        "app/b.cjs": "const x = require('@me/core/both');",
    }
    df = spark.createDataFrame(sorted(files.items()), "path string, text string")
    rows = imports.script_imports(facts.facts(df), df.select("path"), None, df.where("path LIKE '%package.json'")).collect()
    assert {(r.source, r.name, r.target) for r in rows} == {
        ("app/a.ts", "@me/core", "core/src/index.ts"), ("app/a.ts", "@me/core/feat/a", "core/src/feat/a.ts"), ("app/a.ts", "@me/core/feat/deep/x", "core/src/deep/x.ts"), ("app/a.ts", "@me/core/both", "core/src/imp.mjs"),
        ("app/a.ts", "plain", "plain/lib/main.ts"), ("app/a.ts", "plain/lib/util", "plain/lib/util.ts"), ("app/a.ts", "bare", "bare/index.js"), ("app/b.cjs", "@me/core/both", "core/src/req.cjs"),
    }
