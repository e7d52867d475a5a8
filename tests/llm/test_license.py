import duckdb
from pyspark.sql import functions as F

from sabermill.llm import license as lic
from sabermill.llm.shared import Scratch

FILES = [
    (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
    (2, "a/b/c.txt", "nothing here"),
    (3, "a/b/mit/LICENSE", "Released under the MIT License.\nok"),
    (4, "a/b/mit/x/y.txt", "plain"),
    (5, "z.txt", "plain"),
    (6, "q/h.txt", "some words that go on and on, of the sea\nAll rights reserved.\n" + " ".join(f"w{i}" for i in range(60))),
    (7, "q/i.txt", None),
    (8, None, "plain"),
    (9, "", ""),
    (10, "a/b/mit/x/y.txt", "plain"),
    (11, "w/v.txt", "the license of the version is public and in the sea"),
    (12, "src/x.py", "# some tool\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n# http://www.apache.org/licenses/LICENSE-2.0\n#\n"
     "# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an \"AS IS\" BASIS,\n# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n# See the License for the specific language governing permissions and\n# limitations under the License.\nimport os"),
    (13, "gpl/COPYING", lic.TEMPLATES["GPL-3.0/header"].replace(", ", ",\n")),
    (14, "gpl/src/deep/y.c", "plain"),
    (15, "w/u.txt", "and this work of ours is released under the MIT License in the sea"),
]


def test_inheritance_and_oracle(spark):
    files = spark.createDataFrame(FILES, "doc_id long, path string, text string")
    got = {r.doc_id: r for r in lic.license_scan(files, Scratch(spark)).collect()}
    assert {i: (r.license, r.origin) for i, r in got.items()} == {
        1: ("Apache-2.0", "header"), 2: ("Apache-2.0", "inherited"), 3: ("MIT", "header"), 4: ("MIT", "inherited"), 5: ("", "none"), 6: ("Proprietary", "header"),
        7: ("", "none"), 8: ("", "none"), 9: ("", "none"), 10: ("MIT", "inherited"), 11: ("", "none"),
        12: ("Apache-2.0", "header"), 13: ("GPL-3.0", "header"), 14: ("GPL-3.0", "inherited"), 15: ("", "none"),
    }
    table = files.toPandas()
    con = duckdb.connect()
    con.register("files", table)
    want = con.sql(lic.oracle("SELECT * FROM files")).fetchall()
    assert sorted(want) == sorted((r.doc_id, r.path, r.license, r.origin, r.similarity, r.matched_lines) for r in got.values())
    assert lic.license_scan(files.where("false"), Scratch(spark)).count() == 0


def test_common_words_cost_little(spark):
    """A notice with ordinary words around it is found where these words are ordinary, and not where they are rare; a root licence reaches every directory."""
    notice = "and this file is released under the MIT License in the sea"
    rows = [(i, f"d{i % 5}/f{i}", "this file is of the sea and in it " + f"w{i}") for i in range(300)] + [(900, "LICENSE", notice)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit(1)).withColumn("row", F.lit(2))
    got = {r.doc_id: (r.license, r.origin) for r in lic.license_scan(files, Scratch(spark)).collect()}
    assert got.pop(900) == ("MIT", "header") and set(got.values()) == {("MIT", "inherited")}


def test_terms_are_counted_before_they_are_shuffled(spark):
    plans = {}

    class Seen(Scratch):
        def write(self, df, name):
            plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
            return super().write(df, name)

    rows = [(i, f"d/{i}", "Released under the MIT License." if i % 2 else f"some other words {i}") for i in range(8)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: r.license for r in lic.license_scan(files, Seen(spark)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {k for k, v in got.items() if v == "MIT"} >= {1, 3, 5, 7}
    # no join lies between the terms of the files and their count
    counted = plans["best"].splitlines()
    words = next(i for i, line in enumerate(counted) if "Generate explode" in line and "low" in line)
    above = next(i for i in range(words - 1, -1, -1) if "Join" in counted[i] or "Aggregate" in counted[i])
    assert "Aggregate" in counted[above] and "LeftSemi" not in plans["best"], plans["best"]
