"""Problem 5: figures of keys of which a few hold most records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sampleloom.operators.series import large_series, sample_against_series, series_figures
from sampleloom.registry import query
from sampleloom.session import table

_SERIES_ROWS = r"""series_rows AS (
  SELECT DISTINCT sample_index, in_holdout, unnest(list_filter(regexp_split_to_array(upper(series_id), '[\s,;|/+&]+'), lambda x: x <> '')) AS series_id
  FROM per_sample_de WHERE sample_index IS NOT NULL AND series_id IS NOT NULL),
one AS (SELECT series_id, sample_index, bool_or(coalesce(in_holdout, false)) AS held FROM series_rows GROUP BY ALL)"""


@query("p5_found", f"WITH {_SERIES_ROWS} SELECT series_id FROM one GROUP BY series_id HAVING count(*) >= 0.02 * (SELECT count(DISTINCT sample_index) FROM per_sample_de)")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return large_series(table(spark, d, "per_sample_de"), table(spark, d, "sample_labels")).select("series_id")


@query(
    "p5_series_figures",
    f"""WITH {_SERIES_ROWS}, lab AS (SELECT sample_index, bool_or(is_cvd_disease) AS cvd FROM sample_labels GROUP BY 1)
    SELECT series_id, count(*) AS n_samples, count_if(held) AS n_holdout, count_if(cvd) AS n_cvd, count_if(NOT cvd) AS n_not_cvd, count_if(cvd IS NULL) AS n_cvd_unknown
    FROM one LEFT JOIN lab USING (sample_index) GROUP BY series_id""",
)
def p5_series_figures(spark: SparkSession, d: str) -> DataFrame:
    return series_figures(table(spark, d, "per_sample_de"), table(spark, d, "sample_labels"))


@query(
    "p5_sample_against_series",
    r"""WITH rows AS (SELECT sample_index, unnest(list_distinct(list_filter(regexp_split_to_array(upper(series_id), '[\s,;|/+&]+'), lambda x: x <> ''))) AS series_id, mean_abs_z FROM per_sample_de WHERE sample_index IS NOT NULL),
    one AS (SELECT series_id, sample_index, max(mean_abs_z)::DECIMAL(20,9) AS z FROM rows GROUP BY ALL),
    mean AS (SELECT series_id, sum(z)::DOUBLE / nullif(count(z), 0) AS m, count(*) AS n_samples FROM one GROUP BY 1)
    SELECT series_id, sample_index, n_samples, round(z::DOUBLE - m, 6) AS above_series FROM one JOIN mean USING (series_id)""",
)
def p5_sample_against_series(spark: SparkSession, d: str) -> DataFrame:
    return sample_against_series(table(spark, d, "per_sample_de"))
