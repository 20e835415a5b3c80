"""Table schemas and the fixed values the enrollment rules are written in."""

from __future__ import annotations

from pyspark.sql import types as T

SECTION_SCHEMA = T.StructType(
    [
        T.StructField("term", T.IntegerType()),
        T.StructField("term_desc", T.StringType()),
        T.StructField("crn", T.IntegerType()),
        T.StructField("subj", T.StringType()),
        T.StructField("crse", T.IntegerType()),
        T.StructField("sec", T.StringType()),
        T.StructField("credits", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("act", T.IntegerType()),
        T.StructField("xl_act", T.DoubleType()),
    ]
)

ACCURACY_SCHEMA = T.StructType(
    [
        T.StructField("Rank", T.LongType()),
        T.StructField("Subject", T.StringType()),
        T.StructField("Course", T.StringType()),
        T.StructField("Avg_Enrollment", T.DoubleType()),
        T.StructField("Num_Predictions", T.LongType()),
        T.StructField("Std_Enrollment", T.DoubleType()),
        T.StructField("Variability_Pct", T.DoubleType()),
        T.StructField("MAE", T.DoubleType()),
        T.StructField("MAPE", T.DoubleType()),
    ]
)

# What a scoring run returns; files may hold any subset of these.
PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("term", T.IntegerType()),
        T.StructField("subj", T.StringType()),
        T.StructField("crse", T.StringType()),
        T.StructField("credits", T.DoubleType()),
        T.StructField("act", T.DoubleType()),
        T.StructField("prediction", T.DoubleType()),
    ]
)

TARGET = "act_enrollment"

# Term-code suffix of each season.
SEASON_SUFFIX = {"fall": 10, "spring": 40}

# Subject codes with a department name. ENT has none on purpose.
DEPARTMENTS = {
    "AC": "Accounting",
    "FIN": "Finance",
    "MGT": "Management",
    "MIS": "Management Information Systems",
    "MKT": "Marketing",
    "BUS": "Business Administration",
    "LAW": "Business Law & Ethics",
    "MC": "Managerial Communication",
}

# Column names of the report, by the name used in the data.
REPORT_NAMES = {
    "subj": "Subject",
    "crse": "Course",
    "term": "Term",
    "credits": "Credits",
    "prediction": "Predicted_Enrollment",
    "act": "Actual_Enrollment",
}

# Accuracy bands and histogram edges, in percent of MAPE.
GOOD_BELOW = 20
POOR_FROM = 40
MAPE_EDGES = (0, 10, 20, 30, 40, 50, 100, 500, 3000)
MAPE_LABELS = (
    "0-10%", "10-20%", "20-30%", "30-40%", "40-50%", "50-100%", "100-500%", "500%+",
)

# Cell texts that a CSV reader of this data treats as missing.
CSV_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
