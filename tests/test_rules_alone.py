"""One rule alone: the same texts as the chain of that rule, and repeated texts rewritten once."""

from pyspark.sql import functions as F

from plectrum.functions import rules
from plectrum.plans import spoken

TEXTS = [
    None, "", "sin cambios", "nº 1 y nº 2, pág. 3 y págs. 4", "a  nº 3  12 %", "12,5 % y 3 % ", "CNMV/BOE (UE)", "el 1/2/2020 y el 31/2/2020", "5 € y 1.000.000 €",
    "LEI 0123456789ABCDEFGHIJ y 0123456789abcdefghij", "0123456789ABCDEFGHIJ sin nombre", "ISIN ES0123456789 ISIN xx0000000000", "art. 3.2 a) y arts. 4.", "T+2, D+11", "1º, 2ª y 99º", "12:30 y 1:00", "1-2, 3–4",
]


def test_one_rule_alone_is_a_chain_of_one(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    for rule in rules.RULES:
        want = rules.apply_rules(df, rules=(rule,)).select("id", "spoken")
        got = df.select("id", rules.rewritten(rule.id, F.col("text")).alias("spoken"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), rule.id


def test_texts_that_repeat_are_rewritten_once(spark, tmp_path):
    keys = [0, 1, 999, 1000, 999_999, 1_000_000, 8_999_999, None]
    spark.createDataFrame([(k, 1) for k in keys], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    out = spoken.rule_outputs(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == len(spoken._FEW_TEXTS)
    rows = {r["o_orderkey"]: r for r in out.collect()}
    assert set(rows) == set(keys)
    assert rows[1_000_000]["numbers"] == "un millón" and rows[8_999_999]["currencies"] == "treinta y siete euros"
    assert rows[999]["dates"] == rows[999]["dates_iso"] == "20 de abril de 2029" and rows[None]["dates"] == ""
