"""Looking names, units and reference ranges up in a dictionary of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Each measurement's name, standard unit, category and other names; spellings that differ in case only stand once.
NAMES = [
    ("Glucose", "mg/dL", "Metabolic", ["GLUCOSE", "Blood Glucose", "Fasting Glucose", "Fasting Blood Sugar", "FBS", "GLU", "Blood Sugar", "FASTING BLOOD SUGAR(GLUCOSE)"]),
    ("HbA1c", "%", "Metabolic", ["GLYCOSYLATED HEMOGLOBIN", "HBA1C", "A1c", "Glycated Hemoglobin", "Hemoglobin A1c"]),
    ("Total Cholesterol", "mg/dL", "Lipid", ["CHOLESTEROL", "T-Chol", "TOTAL CHOLESTEROL", "CHOLESTEROL-TOTAL", "T. Cholesterol", "Serum Cholesterol"]),
    ("HDL", "mg/dL", "Lipid", ["HDL CHOLESTEROL", "HDL-C", "HDL-CHOLESTEROL", "High Density Lipoprotein", "Good Cholesterol"]),
    ("LDL", "mg/dL", "Lipid", ["LDL CHOLESTEROL", "LDL-C", "LDL-CHOLESTEROL", "Low Density Lipoprotein", "Bad Cholesterol"]),
    ("Triglycerides", "mg/dL", "Lipid", ["TRIGLYCERIDES", "TG", "Trigs", "Triglyceride"]),
    ("Hemoglobin", "g/dL", "Hematology", ["HGB", "HB", "HEMOGLOBIN", "HEMOGLOBIN(HB)"]),
    ("RBC Count", "mil/µL", "Hematology", ["RBC", "Red Blood Cell Count", "Erythrocytes", "Red Cell Count", "REDBLOODCELL(RBC)COUNT"]),
    ("WBC Count", "thou/µL", "Hematology", ["WBC", "White Blood Cell Count", "Leukocytes", "White Cell Count", "WHITEBLOODCELL(WBC)COUNT"]),
    ("Platelets", "thou/µL", "Hematology", ["PLT", "Platelet Count", "Thrombocytes", "PLATELETCOUNT"]),
    ("TSH", "µIU/mL", "Endocrine", ["Thyroid Stimulating Hormone", "Thyrotropin", "TSH - ULTRASENS", "Thyroid-Stimulating Hormone"]),
    ("T3", "ng/dL", "Endocrine", ["Triiodothyronine", "Total T3", "TOTAL TRIIODOTHYRONINE (T3)", "T3 TOTAL", "Total Triiodothyronine"]),
    ("T4", "µg/dL", "Endocrine", ["Thyroxine", "Total T4", "TOTAL THYROXINE (T4)", "T4 TOTAL", "Total Thyroxine"]),
    ("Vitamin D", "ng/mL", "Vitamin", ["25-OH Vitamin D", "25-Hydroxyvitamin D", "25-OH VITAMIN D (TOTAL)", "Vitamin D3", "25-OH Vit D", "25(OH)D"]),
    ("Vitamin B12", "pg/mL", "Vitamin", ["VITAMIN B-12", "Cobalamin", "B12", "VITAMIN B12", "Vit B12"]),
    ("ALT", "U/L", "Liver", ["Alanine Aminotransferase", "SGPT", "ALANINE TRANSAMINASE", "SGPT-ALANINE AMINOTRANSFERASE"]),
    ("AST", "U/L", "Liver", ["Aspartate Aminotransferase", "SGOT", "ASPARTATE TRANSAMINASE", "SGOT-ASPARTATE AMINOTRANSFERASE"]),
    ("Creatinine", "mg/dL", "Kidney", ["CREATININE", "Serum Creatinine", "CREATININE-SERUM"]),
    ("BUN", "mg/dL", "Kidney", ["Blood Urea Nitrogen", "Urea Nitrogen", "UREA"]),
    ("Sodium", "mmol/L", "Electrolyte", ["Na", "SODIUM", "Serum Sodium", "SODIUM-SERUM"]),
    ("Potassium", "mmol/L", "Electrolyte", ["K", "POTASSIUM", "Serum Potassium", "POTASSIUM-SERUM"]),
    ("Chloride", "mmol/L", "Electrolyte", ["Cl", "CHLORIDE", "Serum Chloride", "CHLORIDE-SERUM"]),
]
# Factors of other units to the standard one, by name; spellings that differ in case only are one unit.
FACTORS = [
    ("Glucose", {"mmol/L": 18.0182}), ("HbA1c", {"mmol/mol": 0.09148}), ("Total Cholesterol", {"mmol/L": 38.67}), ("HDL", {"mmol/L": 38.67}),
    ("LDL", {"mmol/L": 38.67}), ("Triglycerides", {"mmol/L": 88.57}), ("Hemoglobin", {"g/L": 0.1}),
    ("RBC Count", {"mil/uL": 1.0, "10^6/µL": 1.0, "10^6/uL": 1.0, "x10^12/L": 1.0, "10^12/L": 1.0}),
    ("WBC Count", {"thou/uL": 1.0, "10^3/µL": 1.0, "10^3/uL": 1.0, "x10^9/L": 1.0, "10^9/L": 1.0, "K/uL": 1.0, "K/µL": 1.0}),
    ("Platelets", {"thou/uL": 1.0, "10^3/µL": 1.0, "10^3/uL": 1.0, "x10^9/L": 1.0, "10^9/L": 1.0, "K/uL": 1.0, "K/µL": 1.0}),
    ("TSH", {"uIU/mL": 1.0, "mIU/L": 1.0}), ("T3", {"nmol/L": 65.1}), ("T4", {"ug/dL": 1.0, "nmol/L": 12.87}), ("Vitamin D", {"nmol/L": 0.4}),
    ("Vitamin B12", {"pmol/L": 0.738}), ("ALT", {"IU/L": 1.0}), ("AST", {"IU/L": 1.0}), ("Creatinine", {"µmol/L": 0.0113, "umol/L": 0.0113}),
    ("BUN", {"mmol/L": 2.8}), ("Sodium", {"mEq/L": 1.0}), ("Potassium", {"mEq/L": 1.0}), ("Chloride", {"mEq/L": 1.0}),
]
# Reference ranges in the standard unit, in order: kind, low, high, context.
RANGES = [
    ("Glucose", [("adult", 70, 99, "fasting"), ("pre_diabetic", 100, 125, "fasting"), ("diabetic", 126, None, "fasting")]),
    ("HbA1c", [("normal", None, 5.6, None), ("pre_diabetic", 5.7, 6.4, None), ("diabetic", 6.5, None, None)]),
    ("Total Cholesterol", [("desirable", None, 200, None), ("borderline_high", 200, 239, None), ("high", 240, None, None)]),
    ("HDL", [("low", None, 50, None), ("optimal", 60, None, None)]),
    ("LDL", [("optimal", None, 100, None), ("near_optimal", 100, 129, None), ("borderline_high", 130, 159, None), ("high", 160, 189, None), ("very_high", 190, None, None)]),
    ("Triglycerides", [("normal", None, 150, None), ("borderline_high", 150, 199, None), ("high", 200, 499, None), ("very_high", 500, None, None)]),
    ("Hemoglobin", [("male", 13.0, 17.0, None), ("female", 12.0, 15.5, None)]), ("RBC Count", [("male", 4.5, 5.9, None), ("female", 4.0, 5.2, None)]),
    ("WBC Count", [("adult", 4.0, 11.0, None)]), ("Platelets", [("adult", 150, 450, None)]), ("TSH", [("adult", 0.4, 4.0, None)]),
    ("T3", [("adult", 80, 200, None)]), ("T4", [("adult", 5.0, 12.0, None)]),
    ("Vitamin D", [("deficiency", None, 20, None), ("insufficiency", 20, 30, None), ("sufficiency", 30, 100, None), ("toxicity", 100, None, None)]),
    ("Vitamin B12", [("adult", 200, 900, None)]), ("ALT", [("male", None, 41, None), ("female", None, 33, None)]),
    ("AST", [("male", None, 40, None), ("female", None, 32, None)]), ("Creatinine", [("male", 0.7, 1.3, None), ("female", 0.6, 1.1, None)]),
    ("BUN", [("adult", 7, 20, None)]), ("Sodium", [("adult", 135, 145, None)]), ("Potassium", [("adult", 3.5, 5.0, None)]), ("Chloride", [("adult", 98, 107, None)]),
]


def names_table(spark: SparkSession) -> DataFrame:
    """spelling (upper case), standard: one row for each name and other name; of several standards of a spelling, the first."""
    rows = {}
    for standard, _, _, others in NAMES:
        for s in others:
            rows.setdefault(s.upper(), standard)
    return spark.createDataFrame([*rows.items()], "spelling string, standard string")


def units_table(spark: SparkSession) -> DataFrame:
    """standard, standard_unit, dictionary_category."""
    return spark.createDataFrame([(n, u, c) for n, u, c, _ in NAMES], "standard string, standard_unit string, dictionary_category string")


def factors_table(spark: SparkSession) -> DataFrame:
    """standard, unit, factor."""
    return spark.createDataFrame([(n, u, f) for n, by in FACTORS for u, f in by.items()], "standard string, unit string, factor double")


def ranges_table(spark: SparkSession) -> DataFrame:
    """standard, place (its order), kind, low, high, context."""
    rows = [(n, i, k, low and float(low), high and float(high), c) for n, many in RANGES for i, (k, low, high, c) in enumerate(many)]
    return spark.createDataFrame(rows, "standard string, place int, kind string, low double, high double, context string")


def standard_names(rows: DataFrame, name: str = "name", units: DataFrame | None = None, spellings: DataFrame | None = None) -> DataFrame:
    """``rows`` with standard_name, standard_unit and dictionary_category.

    A name that is a standard one (blanks around it aside) stays; else one of the other spellings, case aside, gives its
    standard; else the name stays as it is, without unit, and its category is Other. The tables may be given; the library's
    own have a hundred rows, and so are broadcast.
    """
    own = units is None and spellings is None
    hint = F.broadcast if own else (lambda t: t)
    spark = rows.sparkSession
    units, spellings = units or units_table(spark), spellings or names_table(spark)
    given = rows.withColumn("__n", F.trim(name))
    exact = hint(units.select(F.col("standard").alias("__exact")))
    alias = hint(spellings.select(F.col("spelling").alias("__s"), F.col("standard").alias("__alias")))
    found = given.join(exact, F.col("__n") == F.col("__exact"), "left").join(alias, F.upper("__n") == F.col("__s"), "left")
    found = found.withColumn("standard_name", F.coalesce("__exact", "__alias", "__n")).drop("__n", "__s", "__exact", "__alias")
    one = hint(units.select(F.col("standard").alias("standard_name"), "standard_unit", "dictionary_category"))
    return found.join(one, "standard_name", "left").select(
        *rows.columns, "standard_name", "standard_unit", F.coalesce("dictionary_category", F.lit("Other")).alias("dictionary_category")
    )


def standard_values(rows: DataFrame, name: str = "name", value: str = "value", unit: str = "unit", factors: DataFrame | None = None) -> DataFrame:
    """``rows`` with the columns of ``standard_names``, converted_value and converted_unit.

    The standard unit, case aside, needs no factor; else the factor of the very unit, else that of the unit in another case;
    a unit without factor, and a name without entry, leave value and unit unchanged.
    """
    hint = F.broadcast if factors is None else (lambda t: t)
    table = factors or factors_table(rows.sparkSession)
    exact = hint(table.select(F.col("standard").alias("__a"), F.col("unit").alias("__u"), F.col("factor").alias("__f")))
    any_case = hint(table.groupBy(F.col("standard").alias("__b"), F.lower("unit").alias("__v")).agg(F.min("factor").alias("__g")))
    named = standard_names(rows, name)
    both = named.join(exact, (F.col("standard_name") == F.col("__a")) & (F.col(unit) == F.col("__u")), "left")
    both = both.join(any_case, (F.col("standard_name") == F.col("__b")) & (F.lower(unit) == F.col("__v")), "left")
    same = F.lower(F.trim(unit)) == F.lower(F.trim("standard_unit"))
    factor = F.when(same, 1.0).otherwise(F.coalesce("__f", "__g"))
    return both.select(
        *named.columns, (F.col(value) * F.coalesce(factor, F.lit(1.0))).alias("converted_value"),
        F.when(factor.isNotNull(), F.col("standard_unit")).otherwise(F.col(unit)).alias("converted_unit"),
    )


def _preferred(kind: Column, context: Column, low: Column, high: Column, gender: Column, wanted: Column) -> Column:
    """Which range is taken: of the gender, of the context, adult, normal, the first with both bounds; null for none of these."""
    return (
        F.when(kind == F.lower(gender), 0).when(context == F.lower(wanted), 1).when(kind == "adult", 2).when(kind == "normal", 3)
        .when(low.isNotNull() & high.isNotNull(), 4)
    )


def reference_ranges(rows: DataFrame, name: str = "name", gender: str | None = None, context: str | None = None, ranges: DataFrame | None = None) -> DataFrame:
    """``rows`` with the columns of ``standard_names`` and reference_kind, reference_low, reference_high.

    The dictionary's ranges of a name become one array (a few entries), so a row meets its ranges by one lookup, and the
    choice between them is made in the row.
    """
    hint = F.broadcast if ranges is None else (lambda t: t)
    table = ranges or ranges_table(rows.sparkSession)
    many = table.groupBy(F.col("standard").alias("__s")).agg(F.array_sort(F.collect_list(F.struct("place", "kind", "low", "high", "context"))).alias("__r"))
    column = lambda c: F.col(c) if c else F.lit(None).cast("string")
    ranked = F.transform("__r", lambda r: F.struct(
        _preferred(r["kind"], r["context"], r["low"], r["high"], column(gender), column(context)).alias("rank"),
        r["place"].alias("place"), r["kind"].alias("kind"), r["low"].alias("low"), r["high"].alias("high"),
    ))
    named = standard_names(rows, name)
    met = named.join(hint(many), F.col("standard_name") == F.col("__s"), "left").withColumn("__best", F.array_min(F.filter(ranked, lambda r: r["rank"].isNotNull())))
    return met.select(*named.columns, *[F.col(f"__best.{c}").alias(f"reference_{c}") for c in ("kind", "low", "high")])


def first_mentions(rows: DataFrame, keys: list[str], order: list[Column], name: str = "name") -> DataFrame:
    """The first row of each standard name within ``keys``; blank names go."""
    w = Window.partitionBy(*keys, F.lower(F.trim("standard_name"))).orderBy(*order)
    named = standard_names(rows, name).where(F.trim("standard_name") != "")
    return named.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
