from pyspark.sql import functions as F

from corpuscle.operators import facts, imports, snapshot


def rebuilt(files):
    rows = facts.facts(files)
    configs = files.where(F.col("path").rlike(r"\.json$"))
    found = imports.import_map(rows, files.select("path"), None if configs.isEmpty() else configs)
    return sorted(map(tuple, rows.collect())), sorted(map(tuple, found.collect()))


def test_refresh_equals_a_rebuild(spark, tmp_path):
    tree = {
        "pkg/__init__.py": "from .core import Runner\n", "pkg/core.py": "from . import util\nfrom .util import helper\nfrom .late import thing\n", "pkg/util.py": "def helper(x):\n    return x\n", "pkg/sub/__init__.py": "", "pkg/sub/deep.py": "from .. import util\nfrom ..core import Runner\nfrom ... import other\n",
        "main.py": "import pkg.core\nimport pkg.sub.deep\nfrom pkg import util\n", "web/index.ts": "export * from './shapes';\nimport '@/late';\n", "web/shapes.ts": "import { a } from './area';\nimport '..';\n", "web/area.ts": "export const a = 1;\n", "tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}',
    }
    versions = snapshot.Snapshot(spark, str(tmp_path / "snapshot"))

    def refresh():
        files = spark.createDataFrame(sorted(tree.items()), "path string, text string")
        done = versions.refresh(files)
        got = sorted(map(tuple, versions.table("facts").select(*facts.facts(files).columns).collect())), sorted(map(tuple, versions.table("imports").select("source", "target").collect()))
        assert got == rebuilt(files)
        return done

    assert versions.version() is None
    assert refresh().parsed == 10
    assert (refresh().parsed, versions.version()) == (0, 1)
    tree["pkg/util.py"] = "def helper(x):\n    return [x]\n\n\ndef more():\n    pass\n"
    done = refresh()
    assert (done.parsed, done.removed, done.resolved) == (1, 0, 1)
    tree["pkg/late.py"] = "thing = 1\n"
    done = refresh()
    assert done.parsed == 1 and 2 <= done.resolved <= 3 and ("pkg/core.py", "pkg/late.py") in {tuple(r) for r in versions.table("imports").collect()}
    del tree["pkg/util.py"]
    assert refresh().removed == 1
    tree |= {"src/late.ts": "export {}\n", "index.ts": "export {}\n"}
    assert refresh().parsed == 2
    tree["tsconfig.json"] = '{"compilerOptions": {"paths": {"@/*": ["lib/*"]}}}'
    tree["lib/late.ts"] = "export {}\n"
    assert refresh().parsed == 2
    del tree["pkg/__init__.py"]
    refresh()
    assert versions.table("imports", 0).count() > 0
