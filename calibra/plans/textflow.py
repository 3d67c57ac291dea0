"""From titles to structural families and text clusters: attributes, vocabulary, vectors, centres, assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.operators import text
from calibra.operators.attributes import attributes
from calibra.operators.guards import require
from calibra.operators.sampling import stable_sample
from calibra.operators.stage import discard, staged
from calibra.plans.base import query
from calibra.plans.market import _SPLIT, split_of
from calibra.sources import adapter

#: Rows of the training sample that text_vocabulary describes, as its SQL does. The fits below take all training rows.
FIT_ROWS = 20_000

_ATTRIBUTES = adapter.CONTRACTS_SQL + r""", a AS (SELECT *, trim(title || ' ' || yes_sub_title) AS text, split_part(event_ticker, '-', 1) AS series, lower(CASE WHEN yes_sub_title <> '' THEN yes_sub_title ELSE title END) AS claim FROM contracts),
b AS (SELECT *, CASE WHEN regexp_matches(lower(text), '\b(automobile|machinery)\b') THEN 'industry' WHEN regexp_matches(lower(text), '\bbuilding\b') THEN 'property' ELSE 'home' END AS domain,
  CASE WHEN regexp_matches(claim, '\d+ to \d+') THEN 'interval' WHEN regexp_matches(claim, '\b(above|at least)\b') THEN 'above' WHEN regexp_matches(claim, '\bbelow\b') THEN 'below' WHEN contains(lower(text), 'winner') THEN 'winner' ELSE 'unknown' END AS structure FROM a),
families AS (SELECT ticker, event_id, text, domain, CASE WHEN structure = 'unknown' THEN series ELSE regexp_extract(lower(text), '\bin the ([a-z ]+) region\b', 1) END AS underlying, structure,
  CASE WHEN structure IN ('above', 'interval') THEN CAST(regexp_extract(claim, '(\d+)', 1) AS DOUBLE) END AS low,
  CASE structure WHEN 'interval' THEN CAST(regexp_extract(claim, 'to (\d+)', 1) AS DOUBLE) WHEN 'below' THEN CAST(regexp_extract(claim, '(\d+)', 1) AS DOUBLE) END AS high FROM b)
"""


def families(spark, sf_dir) -> DataFrame:
    """Every contract with its text, split and structural family."""
    return attributes(adapter.contracts(spark, sf_dir)).withColumn("split", split_of(F.col("event_id"), F.col("ticker")))


@query("contract_attributes", _ATTRIBUTES + "SELECT ticker, domain, underlying, structure, low, high, domain || '/' || underlying || '/' || structure AS family FROM families")
def contract_attributes(spark, sf_dir):
    return attributes(adapter.contracts(spark, sf_dir)).select("ticker", "domain", "underlying", "structure", "low", "high", "family")


def training_sample(spark, sf_dir, rows: int = FIT_ROWS) -> DataFrame:
    return stable_sample(families(spark, sf_dir).where("split = 'train'"), "ticker", rows)


@query("text_vocabulary", _SPLIT + _ATTRIBUTES + rf""", s AS (SELECT f.ticker, lower(f.text) AS text FROM families f JOIN named n USING (ticker) WHERE n.split = 'train' ORDER BY sha256('42:' || f.ticker), f.ticker LIMIT {FIT_ROWS}),
w AS (SELECT ticker, regexp_extract_all(text, '\b\w\w+\b') AS w FROM s), u AS (SELECT ticker, unnest(w) AS t, unnest(range(len(w))) AS i FROM w),
p AS (SELECT ticker, t, lead(t) OVER (PARTITION BY ticker ORDER BY i) AS t2 FROM u),
t AS (SELECT ticker, t AS term FROM p UNION ALL SELECT ticker, t || ' ' || t2 FROM p WHERE t2 IS NOT NULL),
g AS (SELECT term, count(*) AS tf, count(DISTINCT ticker) AS df FROM t GROUP BY term HAVING count(DISTINCT ticker) >= 2),
k AS (SELECT * FROM g ORDER BY tf DESC, term LIMIT 20000)
SELECT term, tf, df, round(ln((1.0 + (SELECT count(*) FROM s)) / (1.0 + df)) + 1.0, 9) AS idf FROM k""")
def text_vocabulary(spark, sf_dir):
    """Words and pairs of words of the training sample, with their inverse document frequency."""
    return text.vocabulary(training_sample(spark, sf_dir)).select("term", "tf", "df", F.round("idf", 9).alias("idf"))


def titles(spark, sf_dir) -> DataFrame:
    """Every contract's event, split, family and text, joined once and written: fit, centres and assignment read this table."""
    return staged(families(spark, sf_dir).select("ticker", "event_id", "split", "family", "text"), "zstd")


def fit(rows: DataFrame) -> tuple[text.Encoder, DataFrame]:
    """(encoder, bags): fitted on all training rows, which the bags hold by family."""
    require(rows.select("ticker", "event_id", "split"), "ticker", "event_id", "split")  # no contract twice, no event in two splits
    train = rows.where("split = 'train'").select("ticker", "family", "text")
    encoder = text.fit_vocabulary(train)
    bags = staged(encoder.bags(train, "text", "ticker", ("family",)))
    return text.fit_bags(encoder, bags), bags


def fitted(spark, sf_dir) -> text.Encoder:
    return fit(titles(spark, sf_dir))[0]


def vectors(spark, sf_dir) -> DataFrame:
    rows = titles(spark, sf_dir)
    return fit(rows)[0].encode(rows).drop("text")


@query("text_vectors")
def text_vectors(spark, sf_dir):
    """The unit vectors of all contracts on the singular vectors of the training contracts."""
    return vectors(spark, sf_dir)


def centred(spark, sf_dir):
    """(titles, encoder, centres): centres of all the families' training rows. Rows with the same known terms become one vector."""
    rows = titles(spark, sf_dir)
    encoder, bags = fit(rows)
    centres = staged(text.family_centres(bags, encoder=encoder))
    discard(bags)
    return rows, encoder, centres


@query("text_centres")
def text_centres(spark, sf_dir):
    return centred(spark, sf_dir)[2]


def assigned(spark, sf_dir) -> DataFrame:
    rows, encoder, centres = centred(spark, sf_dir)
    near = staged(text.nearest_centres(rows, centres, "ticker", encoder=encoder))
    discard(rows)
    return text.assignments(near)


@query("text_assignments")
def text_assignments(spark, sf_dir):
    """Every contract with its text cluster, or why it has none."""
    return assigned(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@query("assignment_coverage")
def assignment_coverage(spark, sf_dir):
    """Contracts and their share by split and status."""
    n = assigned(spark, sf_dir).groupBy("split").pivot("status", ["assigned", "distant", "insufficient_training_support", "unseen_family"]).count().fillna(0)
    total = F.expr("assigned + distant + insufficient_training_support + unseen_family")
    return n.withColumns({"contracts": total, "assigned_share": F.col("assigned") / total})


@query("cluster_support")
def cluster_support(spark, sf_dir):
    """Contracts and events of each cluster by split."""
    return assigned(spark, sf_dir).where("cluster IS NOT NULL").groupBy("cluster", "split").agg(F.count(F.lit(1)).alias("contracts"), F.countDistinct("event_id").alias("events"))
