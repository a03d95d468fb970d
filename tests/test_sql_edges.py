"""Queries on odd inputs give the rows of their SQL in DuckDB."""

import duckdb
from pyspark.sql import functions as F

from voicewright.functions import text
from voicewright.plans import catalog


def both(spark, folder, name, **tables):
    """Sorted rows of the query and of its SQL over ``tables``: column types and rows."""
    con = duckdb.connect()
    for table, (kinds, rows) in tables.items():
        con.execute(f"create table {table}({kinds})")
        con.executemany(f"insert into {table} values ({', '.join('?' * len(rows[0]))})", rows)
        con.execute(f"copy {table} to '{folder}/{table}.parquet' (format parquet)")
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    return sorted((tuple(r[n] for n in names) for r in catalog.queries()[name](spark, str(folder)).collect()), key=str), sorted(want.fetchall(), key=str)


def test_token_runs_of_odd_texts(spark, tmp_path):
    texts = ["", " \n\t", None, "a A a b", "a\xa0a a", "a\u3000a a", "a\x0ba b", "a\x85a", "İ i̇ i", "ΟΔΟΣ οδος οδοσ", "ΣΣ σσ σς", "ẞ ß", " x  x\r\nx\f"]
    got, want = both(spark, tmp_path, "max_token_run", documents=("doc_id bigint, text varchar", list(enumerate(texts))))
    assert got == want and (3, 3) in got and (12, 3) in got and {0, 1, 2}.isdisjoint(dict(got))


def test_repeats_are_told_without_counting(spark):
    base = "".join(chr(97 + i * 7 % 26) for i in range(200))
    texts = ["", "a", "aa aa aa aa", "aa aa aa", "x aa Aa aA aa", "aa aaa aaa aaa", "a" * 14, "a" * 15, "wxyz" * 11, "wxyz" * 12, "wxyz " * 12, "İ i i i", "σ Σ σς", "abcd" + "".join(f"{chr(97 + i)}fox{i}wolf" for i in range(12))]
    texts += ["".join(f"wxyz{base[i * k : i * k + k]}" for i in range(12)) for k in (0, 1, 2, 5, 9, 16)] + ["".join(f"wxyz{base[i * 9 : i * 9 + 9]}" for i in range(11)), "မင်္ဂလာ " * 4, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    t = F.col("t")
    for most in (1, 3, 11):
        got = rows.select("id", text.max_token_run(t).alias("run"), text.token_run_over(t, most).alias("over"), text.max_fourgram(t).alias("gram"), text.many_fourgrams(t, most).alias("many")).collect()
        for r in got:
            assert texts[r.id] is None or (r.over, r.many) == (r.run > most, r.gram > most), (most, texts[r.id], r)


def test_script_counts_of_odd_letters(spark):
    texts = ["", "aé ÿ", "ªº÷×", "Ⅷ ⅷ x", "ʰʱˠ", "မြန်မာ a", "ລາວ", "ខ្មែរ ᧠", "Ωж字", "1 2 ²"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    m = text.script_metrics(F.col("t"))
    plain = [F.regexp_count("t", F.lit(p)) for p in (r"\p{L}", *text.SCRIPTS.values())]
    for r in rows.select("t", F.array(m["letters"], *(m[k] for k in text.SCRIPTS)).alias("got"), F.array(*plain).alias("want")).collect():
        assert r.got == r.want, r


def test_normalised_texts_are_computed_once(spark):
    """An expression that many rules read stands in the plan once."""
    plan = catalog.queries()["text_quality"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?U)\\s+,  ") == 1
