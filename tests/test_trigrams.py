import os
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import definitions, search, trigrams

PATTERNS = [
    "hello", "hel+o", "h.llo wor", "(foo|bar)baz", "(foo|bar|)baz", "[ab]cde", "colou?r", "x{2,3}yz", "(?i)HELLO", "a.*b", r"\bclass\s+Foo", "^def \\w+", "(abc)+def", "abc(?=def)", "(a|b)(c|d)(e|f)g",
    "", "ab", "[^a]bcd", "foo(bar)?qux", "(?:one|two)three(?:four|five)", "é+tat", "Straße", search.definition_pattern("helper"),
]


def test_certain_grams_are_in_every_match():
    rng = random.Random(2)
    parts = ["hello", "helllo", "world", "foo", "bar", "baz", "acde", "bcde", "color", "colour", "xxyz", "xxxyz", "class Foo", "def f", "abcdef", "aceg", "bdfg", "qux", "onethreefour", "étéétat", "straße", "helper = 3", " ", "\n", "def helper(x)"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    for pattern in PATTERNS:
        needs = trigrams.regex_needs(pattern)
        for t in texts:
            if re.search(pattern, t, re.I):
                assert any(a <= trigrams._of(t) for a in needs), (pattern, t)
    assert trigrams.regex_needs("(foo|bar)baz") == {trigrams._of("foobaz"), trigrams._of("barbaz")}
    assert trigrams.regex_needs("a.*b") == trigrams.ANYTHING == trigrams.regex_needs("(")
    assert trigrams.regex_needs("hel+o wor") >= {frozenset(["hel", "o w", " wo", "wor"]) | trigrams._of("lo wor")} or trigrams.regex_needs("hel+o wor") != trigrams.ANYTHING


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows = [(f"d{i % 9}/f{i}.py", "\n".join(" ".join(rng.choice(words) for _ in range(8)) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    rows += [("only.py", "def helper(x):\n    return Zebra Crossing\n"), ("other.ts", "const zebracrossing = 1"), ("null.py", None), ("ü.py", "ÜBERALL straße")]
    folder = str(tmp_path_factory.mktemp("index"))
    files = spark.createDataFrame(rows, "path string, text string")
    trigrams.build(files, folder)
    return files.fillna(""), folder, words


def test_scans_are_those_of_all_files(spark, corpus):
    files, folder, words = corpus
    index = trigrams.TrigramIndex(spark, folder)
    for q in ("zebra", "Zebra Crossing", words[3], words[5] + " " + words[6], "ab", "no such text", "überall", "STRASSE"):
        assert sorted(search.literal_matches(index.literal(q), q).collect()) == sorted(search.literal_matches(files, q).collect()), q
    for p in ("zebra.?crossing", f"({words[1]}|{words[2]}) {words[3][:2]}", "^def helper", "(?i)STRAß"):
        assert sorted(index.regex(p).where(F.col("text").rlike(f"(?i){p}")).collect()) == sorted(files.where(F.col("text").rlike(f"(?i){p}")).collect()), p
    assert sorted(search.definition_matches(index.regex(search.definition_pattern("helper")), "helper").collect()) == sorted(search.definition_matches(files, "helper").collect())


def test_only_candidate_blocks_are_read(spark, corpus):
    """Blocks without candidates may be broken: nothing reads them."""
    files, folder, _ = corpus
    index = trigrams.TrigramIndex(spark, folder)
    have = {r.block for r in index.candidates(trigrams.literal_needs("zebra")).collect()}
    assert 0 < len(have) <= 2 and index.candidates(trigrams.literal_needs("no such text")).count() == 0
    for name in os.listdir(f"{folder}/texts"):
        if name.startswith("block=") and int(name[6:]) not in have:
            for part in os.listdir(f"{folder}/texts/{name}"):
                if part.startswith("part-"):
                    with open(f"{folder}/texts/{name}/{part}", "wb") as f:
                        f.write(b"broken")
                    os.remove(f"{folder}/texts/{name}/.{part}.crc")
    assert sorted(r.path for r in search.literal_matches(index.literal("zebra"), "zebra").collect()) == ["only.py", "other.ts"]
    with pytest.raises(Exception):
        index.literal("ab").count() or index.texts.select(F.sum(F.length("text"))).collect()


def test_callable_lines(spark):
    yes = ["function save() {", "export default async function save(", "export const save = async (a) =>", "const save = x => x", "let save: Saver = function (a) {", "private static save(a) {", "save() {", "class save {", "def save(self):", "var save = (", "const save = <T>(a: T) => a", "  async save(a) {"]
    no = ["const save = 3", "const saved = () => 1", "let other = save()", "return save()", "const save = (a + b)", "function saved() {", "import save from 'x'", "", "const save"]
    rows = spark.createDataFrame([(t, True) for t in yes] + [(t, False) for t in no] + [(None, False)], "content string, want boolean")
    assert [r.content for r in rows.where(definitions.is_callable(F.col("content"), "save") != F.col("want")).collect()] == []
