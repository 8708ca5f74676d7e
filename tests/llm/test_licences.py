"""Licence digests: what is the same text and what is not."""

from pathlib import Path

import duckdb
import pytest

from keepsake.llm import licences as L, oracles


def look(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in L.scan(df).collect()}


def test_scan(spark):
    mit = next(t for n, t in L.LICENCES if n == "MIT" and len(t) > 500)
    texts = [
        mit, "Copyright (c) 2020 Jane Roe\n\n" + mit.upper().replace(",", " ;"), mit.replace("sublicense", "sub-licence"), mit + " And more.", None, "", "\n .. \n",
        "Some words.\nReleased under the MIT licence\nmore", "© 2019 X\nLicensed under CC BY-NC 4.0.", "RELEASED UNDER THE MIT LICENSE!!", "we license nothing", mit + "\n" + "(c) 2001 A\n" * 3,
    ]
    got = look(spark, texts)
    assert len(got) == len(texts)
    assert [got[i].licence for i in (0, 1, 2, 3)] == ["MIT", "MIT", "MIT", None]
    assert [got[i].digest for i in (4, 5, 6)] == [None] * 3 and [got[i].licence for i in (4, 5, 6)] == [None] * 3
    assert got[7].licence is None and got[7].notices == ["MIT"]
    assert got[8].licence == "CC-BY-NC-4.0" and got[8].notices == ["CC-BY-NC-4.0"]
    assert got[9].licence == "MIT"
    assert got[10].notices == [] and got[10].licence is None
    assert got[11].licence == "MIT"
    assert got[0].digest == got[1].digest != got[3].digest


def test_repeated_rows_long_texts_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.", "x"), (1, "Released under the MIT License.", "x"), (2, "word " * 100_000, "y")], "doc_id long, text string, licence string")
    got = L.scan(df).collect()
    assert sorted((r.doc_id, r.licence or "") for r in got) == [(1, "MIT"), (1, "MIT"), (2, "")]
    assert L.scan(df.limit(0)).collect() == []
    plan = L.scan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_whole_texts_and_notices_without_the_word(spark):
    whole = L.whole_texts()
    bsd = next(t for n, t in whole if n == "BSD-3-Clause")
    texts = [t for _, t in whole] + ["Some words.\nAll rights reserved.\nmore", "BSD 3-Clause License\n\nCopyright (c) 2020, J Roe\nAll rights reserved.\n\n" + bsd]
    got = look(spark, texts)
    assert [got[i].licence for i in range(len(whole))] == [n for n, _ in whole]
    assert {"Apache-2.0", "BSD-2-Clause", "GPL-3.0-only", "LGPL-3.0-only", "MPL-2.0", "Unlicense", "Zlib", "CC0-1.0"} <= {n for n, _ in whole}
    assert got[len(whole)].licence is None and got[len(whole)].notices == ["LicenseRef-All-Rights-Reserved"]
    assert got[len(whole) + 1].licence == "BSD-3-Clause"
    df = spark.createDataFrame([(1, "a\nOwned by the house!\nb")], "doc_id long, text string")
    assert L.scan(df, licences=[("X", "Owned by the house")]).first().notices == ["X"]


def _sql(rows):
    with duckdb.connect() as db:
        db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
        return sorted(db.execute(oracles.licence_digests()).fetchall())


def test_planted_licences_through_the_join_and_the_sql(spark):
    """Whole texts as people keep them: other titles, holders, case, marks, white space; and near misses."""
    mit = dict(L.LICENCES[:1])["MIT"].removeprefix("MIT License\n")
    wtfpl = (Path(L.__file__).parent / "licence_texts" / "WTFPL.txt").read_text()
    apache = (Path(L.__file__).parent / "licence_texts" / "Apache-2.0.txt").read_text()
    planted = [
        ("MIT", mit), ("MIT", "The MIT License (MIT)\n\nCopyright Jane Roe\n\n" + mit), ("MIT", "MIT License\nCopyright by Jane Q. Roe <jane@example.org>\n" + mit.upper()), ("MIT", "  * " + mit.replace(" ", "\n  * ")),
        ("WTFPL", wtfpl), ("WTFPL", wtfpl.replace("Sam Hocevar", "Someone Else")), ("Apache-2.0", apache), ("Apache-2.0", apache.replace("License", "LICENCE")),
        (None, mit + "\nAnd more."), (None, mit.replace("free of charge", "for a fee")), (None, "Copyright Jane Roe"),
    ]
    rows = [(i, t) for i, (_, t) in enumerate(planted)]
    got = sorted((r.doc_id, r.digest, r.licence, ",".join(r.notices)) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [g[2] for g in got] == [n for n, _ in planted]
    assert got == _sql(rows)


@pytest.mark.parametrize("name", ["Apache-2.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1", "GPL-2", "GPL-3", "LGPL-2", "LGPL-2.1", "LGPL-3", "MPL-1.1", "MPL-2.0"])
def test_the_files_that_systems_keep(spark, name):
    path = Path("/usr/share/common-licenses") / name
    if not path.exists():
        pytest.skip("not on this system")
    assert (look(spark, [path.read_text("utf-8")])[0].licence or "").startswith(name.split("-")[0])
