"""Quality checks on the driver's tables: order lines as layers by line status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions.columns import round_to
from gridlake.functions.geo import line_bytes, with_shape
from gridlake.operators import quality
from gridlake.plans.assets import points
from gridlake.plans.grid import layers, with_grid
from gridlake.plans.registry import query, table
from gridlake.sources.catalog import LayerCatalog
from gridlake.sources.sinks import customers_per_pole

_PHASE = "CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN CASE WHEN l_linenumber < 4 THEN 'ABC' ELSE 'BN' END ELSE CASE WHEN l_linenumber < 3 THEN ' ' ELSE 'AB' END END"
_ROWS = f"r AS (SELECT l_linestatus AS layer, nullif(trim({_PHASE}), '') AS ph, l_suppkey AS f, l_partkey, l_linenumber, l_returnflag FROM lineitem)"


def rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_linestatus AS layer", f"{_PHASE} AS FAS_CON", "l_suppkey AS ctmt", "CASE WHEN l_linenumber = 7 THEN ' ' ELSE CAST(l_partkey AS STRING) END AS TIP_CND",
        "CAST(l_suppkey AS STRING) AS CTMT_REF", "CAST(l_linenumber AS STRING) AS TLCD", "concat(l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber) AS COD_ID",
        "l_extendedprice AS COMP", "l_partkey AS pac", "l_returnflag",
    )


@query(
    "phase_profile",
    f"""WITH {_ROWS}, c AS (SELECT layer, ph, count(*) AS n, row_number() OVER (PARTITION BY layer ORDER BY count(*) DESC, ph) AS k FROM r WHERE ph IS NOT NULL GROUP BY 1, 2)
    SELECT layer, count(*) AS registros, count(ph) AS informados, count(*) FILTER (ph IN ('A', 'BN')) AS monofasicos,
      CAST(count(*) FILTER (ph IN ('A', 'BN')) AS DOUBLE) * 100.0::DOUBLE / CAST(count(ph) AS DOUBLE) AS pct_monofasico,
      (SELECT string_agg(ph || '=' || n, ', ' ORDER BY k) FROM c WHERE c.layer = r.layer AND k <= 5) AS top_valores FROM r GROUP BY 1""",
)
def phase_profile(spark: SparkSession, sf: str) -> DataFrame:
    """A16."""
    return quality.phase_profile(rows(spark, sf))


@query(
    "phase_by_feeder",
    f"""WITH {_ROWS}, c AS (SELECT layer, f AS ctmt, count(*) AS registros, count(*) FILTER (ph IN ('A', 'BN')) AS monofasicos FROM r WHERE ph IS NOT NULL GROUP BY 1, 2)
    SELECT *, CAST(monofasicos AS DOUBLE) * 100.0::DOUBLE / CAST(registros AS DOUBLE) AS pct_monofasico FROM c WHERE registros >= 20 ORDER BY pct_monofasico DESC, monofasicos DESC, layer, ctmt LIMIT 5""",
)
def phase_by_feeder(spark: SparkSession, sf: str) -> DataFrame:
    """A16, T3."""
    return quality.phase_by_feeder(rows(spark, sf))


@query(
    "long_tail_p99",
    """SELECT count(*) FILTER (l_extendedprice > 90000) AS count, count(*) AS universe, CAST(count(*) FILTER (l_extendedprice > 90000) AS DOUBLE) * 100.0::DOUBLE / CAST(count(*) AS DOUBLE) AS percent,
      round_even(quantile_cont(l_extendedprice, 0.99) * 10000, 0) / 10000 AS p99 FROM lineitem""",
)
def long_tail_p99(spark: SparkSession, sf: str) -> DataFrame:
    """A17."""
    return quality.long_tail(rows(spark, sf), limit=90000.0).withColumn("p99", round_to(F.col("p99"), 4))


@query(
    "longest_rows",
    "SELECT concat(l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber) AS COD_ID, l_extendedprice AS COMP FROM lineitem WHERE l_extendedprice > 90000 ORDER BY COMP DESC, COD_ID LIMIT 20",
)
def longest_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A17, T3."""
    return quality.longest(rows(spark, sf), limit=90000.0, n=20).select("COD_ID", "COMP")


@query(
    "shared_nodes",
    "SELECT l_partkey AS pac, count(DISTINCT l_suppkey) AS n_ctmt, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ', ' ORDER BY CAST(l_suppkey AS VARCHAR)) AS ctmts FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1",
)
def shared_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """A18."""
    return quality.shared_nodes(rows(spark, sf))


@query(
    "dangling_refs",
    """WITH r AS (SELECT l_linestatus AS layer, CASE WHEN l_linenumber <> 7 THEN l_partkey END AS c FROM lineitem), k AS (SELECT p_partkey FROM part WHERE p_size <= 40)
    SELECT layer, count(*) AS registros, count(*) FILTER (c IS NULL OR p_partkey IS NULL) AS problemas, count(*) FILTER (c IS NULL) AS vazios, count(*) FILTER (c IS NOT NULL AND p_partkey IS NULL) AS sem_catalogo,
      CAST(count(*) FILTER (c IS NULL OR p_partkey IS NULL) AS DOUBLE) * 100.0::DOUBLE / CAST(count(*) AS DOUBLE) AS percentual FROM r LEFT JOIN k ON p_partkey = c GROUP BY 1""",
)
def dangling_refs(spark: SparkSession, sf: str) -> DataFrame:
    """J11."""
    return quality.dangling_codes(rows(spark, sf), table(spark, sf, "part").where("p_size <= 40").select("p_partkey"))


@query(
    "unknown_references",
    """SELECT l_linestatus AS layer, count(*) AS referencias, count(*) FILTER (s_suppkey IS NULL) AS ausentes, CAST(count(*) FILTER (s_suppkey IS NULL) AS DOUBLE) * 100.0::DOUBLE / CAST(count(*) AS DOUBLE) AS percentual
    FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey GROUP BY 1""",
)
def unknown_references(spark: SparkSession, sf: str) -> DataFrame:
    """J11."""
    return quality.unknown_references(rows(spark, sf), table(spark, sf, "supplier").where("s_acctbal > 0").select("s_suppkey"), ref="CTMT_REF")


@query("unreferenced", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unreferenced(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without any order."""
    return quality.unreferenced(table(spark, sf, "orders").select("o_custkey"), table(spark, sf, "customer").select("c_custkey"), ref="o_custkey")


@query(
    "flag_domain",
    """SELECT l_linestatus AS layer, count(*) AS registros, count(*) FILTER (l_linenumber > 1) AS problemas, 0 AS nulos, count(*) FILTER (l_linenumber > 1) AS indefinidos,
      CAST(count(*) FILTER (l_linenumber > 1) AS DOUBLE) * 100.0::DOUBLE / CAST(count(*) AS DOUBLE) AS percentual FROM lineitem GROUP BY 1""",
)
def flag_domain(spark: SparkSession, sf: str) -> DataFrame:
    """A20."""
    return quality.flag_domain(rows(spark, sf))


@query(
    "one_phase_groups",
    f"""WITH {_ROWS}, c AS (SELECT l_partkey AS k, substr(ph, 1, 1) AS fase, count(*) AS n FROM r WHERE ph IN ('A', 'BN') GROUP BY 1, 2),
      b AS (SELECT *, sum(n) OVER (PARTITION BY k) AS total, row_number() OVER (PARTITION BY k ORDER BY n DESC, fase) AS i FROM c)
    SELECT CAST(k AS VARCHAR) AS UNI_TR_MT, fase, n, CAST(total AS BIGINT) AS total FROM b WHERE i = 1 AND total >= 10 AND n / total >= 0.7""",
)
def one_phase_groups(spark: SparkSession, sf: str) -> DataFrame:
    """A26."""
    return quality.one_phase_transformers(rows(spark, sf).withColumnRenamed("pac", "UNI_TR_MT"), min_rows=10, share=0.7)


@query(
    "geometry_checks",
    """WITH p AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS x1, CAST(embedding[2] AS DOUBLE) AS y1, CAST(embedding[3] AS DOUBLE) AS x2, CAST(embedding[4] AS DOUBLE) AS y2 FROM embeddings),
      g AS (SELECT *, x1 > 0.15 AS missing, x1 < -0.15 AS broken FROM p)
    SELECT label AS layer, count(*) AS registros, count(*) FILTER (missing OR broken) AS problemas, count(*) FILTER (NOT missing) AS mensuraveis,
      count(*) FILTER (NOT missing AND (least(x1, CASE WHEN broken THEN x1 ELSE x2 END) < -0.1 OR least(y1, CASE WHEN broken THEN y1 ELSE y2 END) < -0.1
        OR greatest(x1, CASE WHEN broken THEN x1 ELSE x2 END) > 0.1 OR greatest(y1, CASE WHEN broken THEN y1 ELSE y2 END) > 0.1)) AS fora FROM g GROUP BY 1""",
)
def geometry_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Geometry bytes are built from the vectors and decoded again."""
    p = points(spark, sf)
    broken = F.col("x") < -0.15
    wkb = line_bytes("x", "y", F.when(broken, F.col("x")).otherwise(F.col("x2")), F.when(broken, F.col("y")).otherwise(F.col("y2")))
    shaped = with_shape(p.select(F.col("label").alias("layer"), F.when(F.col("x") > 0.15, F.lit(None).cast("binary")).otherwise(wkb).alias("geometry")))
    return quality.geometry_checks(shaped.select("layer", "shape.*"), (-0.1, -0.1, 0.1, 0.1))


@query(
    "customers_per_pole",
    """WITH r AS (SELECT l_partkey AS p, l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL),
      ma AS (SELECT p, a FROM (SELECT p, a, row_number() OVER (PARTITION BY p ORDER BY sum(n) DESC, a) AS i FROM r GROUP BY 1, 2) WHERE i = 1),
      mb AS (SELECT p, b FROM (SELECT p, b, row_number() OVER (PARTITION BY p ORDER BY sum(n) DESC, b) AS i FROM r GROUP BY 1, 2) WHERE i = 1)
    SELECT CAST(r.p AS VARCHAR) AS PN_CON, CAST(sum(n) AS BIGINT) AS N_UC, any_value(ma.a) AS CTMT, any_value(mb.b) AS CLAS_SUB FROM r JOIN ma ON ma.p = r.p JOIN mb ON mb.p = r.p GROUP BY 1""",
)
def customers_per_pole_query(spark: SparkSession, sf: str) -> DataFrame:
    """A24."""
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("PN_CON"), F.col("l_returnflag").alias("CTMT"), F.col("l_linestatus").alias("CLAS_SUB"))
    return customers_per_pole(lines, modes=("CTMT", "CLAS_SUB"))


@query(
    "quality_summary",
    with_grid(
        """
  refs AS (SELECT CTMT FROM ssdmt UNION ALL SELECT CTMT FROM unsemt UNION ALL SELECT CTMT FROM untrmt UNION ALL SELECT CTMT FROM ucbt_tab UNION ALL SELECT CTMT FROM ucmt_tab
           UNION ALL SELECT CTMT FROM ugbt_tab UNION ALL SELECT CTMT FROM ugmt_tab),
  pacs AS (SELECT PAC_INI AS p, COD_ID AS f FROM ctmt UNION SELECT PAC_1, CTMT FROM ssdmt UNION SELECT PAC_2, CTMT FROM ssdmt UNION SELECT PAC_1, CTMT FROM unsemt UNION SELECT PAC_2, CTMT FROM unsemt
           UNION SELECT PAC_1, CTMT FROM untrmt UNION SELECT PAC, CTMT FROM ucmt_tab),
  pg AS (SELECT p, count(*) AS n FROM pacs GROUP BY 1),
  s AS (SELECT 'fas_con' AS "check", count(*) FILTER (FAS_CON = 'AN') AS c, count(*) AS u FROM ssdmt
        UNION ALL SELECT 'ramlig', 0, 0 UNION ALL SELECT 'pn_con', 0, 0 UNION ALL SELECT 'geometria', 0, 0 UNION ALL SELECT 'bbox', 0, 0
        UNION ALL SELECT 'tip_cnd', count(*) FILTER (TIP_CND NOT IN (SELECT COD_ID FROM segcon)), count(*) FROM ssdmt
        UNION ALL SELECT 'ctmt', count(*) FILTER (CTMT NOT IN (SELECT COD_ID FROM ctmt)), count(*) FROM refs
        UNION ALL SELECT 'ctmt_sem_referencia', count(*) FILTER (COD_ID NOT IN (SELECT CTMT FROM refs)), count(*) FROM ctmt
        UNION ALL SELECT 'pac', count(*) FILTER (n > 1), count(*) FROM pg
        UNION ALL SELECT 'tlcd', count(*) FILTER (TLCD NOT IN (0, 1)), count(*) FROM unsemt)
SELECT "check", c AS count, u AS universe, CASE WHEN u = 0 THEN 0 ELSE CAST(c AS DOUBLE) * 100.0::DOUBLE / CAST(u AS DOUBLE) END AS percent FROM s
""",
        "CTMT", "SSDMT", "UNSEMT", "UNTRMT", "UCBT_tab", "UCMT_tab", "UGBT_tab", "UGMT_tab", "SEGCON", recursive=False,
    ),
)
def quality_summary(spark: SparkSession, sf: str) -> DataFrame:
    """All checks over the derived grid; checks without their layers report zero."""
    frames = {k: v for k, v in layers(spark, sf).items() if k != "INTERLIGACOES"}
    return quality.quality_summary(LayerCatalog.of(spark, frames)).select("check", "count", "universe", "percent")
