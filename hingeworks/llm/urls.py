"""URL filters: host and path rules, and a character language-model ratio, with DataFrame functions only.

Two variable-order Markov models of characters are counted from URLs that the rules accept and reject. Orders 2, 1 and
0 are interpolated by Witten-Bell weights, so a context that is rare leans on the shorter one. With 42 symbols there
are 42^3 context-symbol triples, so both models are one table of 74,088 log-likelihood differences, whatever the input.
One in CALIBRATE of the URLs with a rule, by a hash, teaches neither model; the threshold is calibrated on these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hingeworks.llm.common import cut, cuts_so_far, drop_cuts_since, shuffle_width

#: Fixed values: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols 1 to 40; 41 is any other character, 0 the start or end.
ALPHABET = LOWER + "0123456789/.-_"
A = len(ALPHABET) + 2
#: Calibration bins a unit of score, and the score beyond which all scores share a bin.
BINS, FAR = 200, 20
CALIBRATE = 5
#: A URL that more than one row in so many has is hot; there are fewer such URLs than this, so they can be broadcast.
HOT = 1_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty for null or without ://."""
    rest = _rest(url)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty for null or without ://."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(url.isNotNull() & (at > 0), F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct (size, rule, verdict), or null. The rules are a short fixed list."""
    fits = [
        F.when(((host == F.lit(h)) | host.endswith(F.lit("." + h))) & path.startswith(F.lit(p)), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits))


def _codes(text: Column) -> Column:
    """Symbols of a text between two start marks and an end mark."""
    lower = F.translate(text, UPPER, LOWER)
    chars = F.filter(F.split(lower, ""), lambda c: c != "")
    place = lambda c: F.call_function("locate", c, F.lit(ALPHABET))
    marks = F.transform(chars, lambda c: F.when(place(c) > 0, place(c)).otherwise(F.lit(A - 1)))
    return F.concat(F.array(F.lit(0), F.lit(0)), marks, F.array(F.lit(0)))


def indexes(codes: Column) -> Column:
    """Index of each (two symbols before, symbol)."""
    pair = F.zip_with(codes, F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: a * A + b)
    inner = F.slice(pair, F.lit(1), F.size(codes) - 2)
    return F.zip_with(inner, F.slice(codes, F.lit(3), F.size(codes) - 2), lambda ab, c: ab * A + c)


def ratio_table(counts: DataFrame) -> DataFrame:
    """(idx, d) for all 74,088 triples: the log-likelihood difference accepted minus rejected.

    counts has (idx, good, bad). p2(c|ab) = (n(abc) + T(ab) p1(c|b)) / (n(ab) + T(ab)), T the number of different
    symbols seen there; p1 likewise over p0; p0(c) = (n(c) + 1) / (n + symbols).
    """
    spark = counts.sparkSession
    full = spark.range(A**3).select(F.col("id").alias("idx")).join(F.broadcast(counts), "idx", "left").na.fill(0)
    idx = F.col("idx")
    full = full.select("idx", "good", "bad", F.floor(idx / A).alias("ab"), (idx % (A * A)).alias("bc"), (F.floor(idx / A) % A).alias("b"), (idx % A).alias("c"))
    two = full.groupBy("bc").agg(*[F.sum(k).alias(f"{k}_bc") for k in ("good", "bad")], F.first("b").alias("b_"), F.first("c").alias("c_"))
    over_ab = full.groupBy("ab").agg(*[f(k).alias(f"{k}_{n}") for k in ("good", "bad") for n, f in (("nab", F.sum), ("tab", lambda k: F.sum((F.col(k) > 0).cast("long"))))])
    over_b = two.groupBy("b_").agg(*[f(f"{k}_bc").alias(f"{k}_{n}") for k in ("good", "bad") for n, f in (("nb", F.sum), ("tb", lambda k: F.sum((F.col(k) > 0).cast("long"))))])
    over_c = two.groupBy("c_").agg(*[F.sum(f"{k}_bc").alias(f"{k}_c") for k in ("good", "bad")])
    over_all = over_c.agg(*[F.sum(f"{k}_c").alias(f"{k}_all") for k in ("good", "bad")])
    joined = full.join(F.broadcast(two.drop("b_", "c_")), "bc").join(F.broadcast(over_ab), "ab")
    joined = joined.join(F.broadcast(over_b.withColumnRenamed("b_", "b")), "b").join(F.broadcast(over_c.withColumnRenamed("c_", "c")), "c")
    joined = joined.withColumn("one", F.lit(1)).join(F.broadcast(over_all.withColumn("one", F.lit(1))), "one")

    def log_p(k: str) -> Column:
        p0 = (F.col(f"{k}_c") + 1) / (F.col(f"{k}_all") + A)
        blend = lambda n, t, all_, p: F.when(all_ + t > 0, (n + t * p) / (all_ + t)).otherwise(p)
        p1 = blend(F.col(f"{k}_bc"), F.col(f"{k}_tb"), F.col(f"{k}_nb"), p0)
        return F.log(blend(F.col(k), F.col(f"{k}_tab"), F.col(f"{k}_nab"), p1))

    return joined.select("idx", (log_p("good") - log_p("bad")).alias("d"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Rows (id, host, path, rule, verdict, score): the rule's verdict, else the method's.

    score is the log-likelihood difference of host and path a symbol; a URL without a rule is allowed if its score
    reaches the threshold that errs least, classes weighed alike, on the URLs with a rule that didn't teach the models
    (lowest such on ties). Without such URLs of both verdicts the threshold is 0. Null, empty and malformed URLs have empty host and path and are
    judged by the method; repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    spark, u, before = pages.sparkSession, F.col("url"), cuts_so_far()
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    own = own.select("id", host_of(u).alias("host"), path_of(u).alias("path"))
    urls = own.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    urls = urls.withColumn("apart", F.conv(F.substring(F.md5(F.concat("host", "path")), 1, 8), 16, 10).cast("long") % CALIBRATE == 0)
    urls = cut(urls, "urls").repartition(shuffle_width(spark), "host", "path")  # a row becomes some fifty
    good = F.when(F.col("fit.verdict") == "allow", F.col("n")).otherwise(F.lit(0))
    marks = urls.select("host", "path", "fit", "n", "apart", good.alias("good"), F.explode(indexes(_codes(F.concat("host", "path")))).alias("idx"))
    counts = marks.where(F.col("fit").isNotNull() & ~F.col("apart")).groupBy("idx").agg(F.sum("good").alias("good"), F.sum(F.col("n") - F.col("good")).alias("bad"))
    ratios = cut(ratio_table(counts), "url-ratios")
    scores = marks.join(F.broadcast(ratios), "idx").groupBy("host", "path").agg(
        (F.sum("d") / F.count(F.lit(1))).alias("score"), F.first("fit").alias("fit"), F.first("good").alias("good"), F.first("n").alias("n"), F.first("apart").alias("apart")
    )
    scores = cut(scores, "url-scores")
    drop_cuts_since(before, scores)
    least = _calibrated(scores.where(F.col("fit").isNotNull() & F.col("apart")))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= F.lit(least), "allow").otherwise("block"))
    judged = scores.select("host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score", "n")
    rows, by = scores.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], ["host", "path"]
    hot = F.col("n") * HOT > F.lit(rows)
    often = F.broadcast(judged.where(hot).drop("n"))  # under HOT rows
    out = own.join(often, by).unionByName(own.join(often.select(*by), by, "left_anti").join(judged.where(~hot).drop("n"), by))
    return out.select("id", "host", "path", "rule", "verdict", "score")


def _calibrated(known: DataFrame) -> float:
    """The least threshold, among bin edges, of least mean error over both classes; one number reaches the driver."""
    bin_ = F.floor(F.least(F.greatest("score", F.lit(-FAR)), F.lit(FAR)) * BINS).cast("long")
    counts = known.groupBy(bin_.alias("bin")).agg(F.sum("good").alias("good"), F.sum(F.col("n") - F.col("good")).alias("bad"))
    row = counts.sparkSession.sql(
        """
        SELECT min_by(bin, (round(error, 12), bin)) AS bin, max(goods) AS goods, max(bads) AS bads FROM (
          SELECT bin, sum(good) OVER () AS goods, sum(bad) OVER () AS bads,
                 coalesce(sum(good) OVER w, 0) / greatest(1, sum(good) OVER ()) + 1 - coalesce(sum(bad) OVER w, 0) / greatest(1, sum(bad) OVER ()) AS error
          FROM {bins} WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        """,
        bins=counts,
    ).first()
    return row.bin / BINS if row.bin is not None and row.goods and row.bads else 0.0


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict over every url of `pages`."""
    judged = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def _sql_model(k: str) -> str:
    """Witten-Bell probability of a triple for the counts in column k, as SQL."""
    p1 = f"CASE WHEN {k}_nb + {k}_tb > 0 THEN ({k}_bc + {k}_tb * (({k}_c + 1) / ({k}_all + {A}))) / ({k}_nb + {k}_tb) ELSE ({k}_c + 1) / ({k}_all + {A}) END"
    return f"CASE WHEN {k}_nab + {k}_tab > 0 THEN ({k} + {k}_tab * ({p1})) / ({k}_nab + {k}_tab) ELSE {p1} END"


def _sql_sums(over: str, by: str, names: str) -> str:
    return ", ".join(f"sum({k}{over})::DOUBLE AS {k}_n{names}, sum(({k}{over} > 0)::INT)::DOUBLE AS {k}_t{names}" for k in ("good", "bad")) + f" FROM {by}"


ORACLE = f"""
WITH rules(v, rh, rp) AS (VALUES {", ".join(str(r) for r in RULES)}),
u AS (SELECT page_id, CASE WHEN url IS NOT NULL AND instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
d AS (SELECT host, path, count(*) AS n FROM h GROUP BY host, path),
f AS (SELECT host, path, ('0x' || substr(md5(host || path), 1, 8))::BIGINT % {CALIBRATE} = 0 AS apart, any_value(n) AS n, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS rv
      FROM d LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path),
s AS (SELECT host, path, n, rv, apart, translate(host || path, '{UPPER}', '{LOWER}') AS t FROM f),
c AS (SELECT host, path, n, rv, apart, [0, 0] || list_transform(range(1, length(t) + 1), lambda i: CASE WHEN instr('{ALPHABET}', substr(t, i, 1)) > 0 THEN instr('{ALPHABET}', substr(t, i, 1)) ELSE {A - 1} END) || [0] AS s FROM s),
m AS (SELECT host, path, n, rv, apart, s, unnest(range(1, len(s) - 1)) AS i FROM c),
t AS (SELECT host, path, n, rv, apart, s[i] * {A * A} + s[i + 1] * {A} + s[i + 2] AS idx FROM m),
k AS (SELECT idx, coalesce(sum(n) FILTER (rv = 'allow'), 0) AS good, coalesce(sum(n) FILTER (rv = 'block'), 0) AS bad FROM t WHERE rv IS NOT NULL AND NOT apart GROUP BY idx),
a AS (SELECT r.i AS idx, r.i // {A} AS ab, r.i % {A * A} AS bc, r.i // {A} % {A} AS b, r.i % {A} AS c, coalesce(good, 0)::DOUBLE AS good, coalesce(bad, 0)::DOUBLE AS bad FROM range({A**3}) r(i) LEFT JOIN k ON k.idx = r.i),
two AS (SELECT bc, any_value(b) AS b, any_value(c) AS c, sum(good) AS good_bc, sum(bad) AS bad_bc FROM a GROUP BY bc),
oab AS (SELECT ab, {_sql_sums("", "a", "ab")} GROUP BY ab), ob AS (SELECT b, {_sql_sums("_bc", "two", "b")} GROUP BY b),
oc AS (SELECT c, sum(good_bc) AS good_c, sum(bad_bc) AS bad_c FROM two GROUP BY c), oall AS (SELECT sum(good_c) AS good_all, sum(bad_c) AS bad_all FROM oc),
l AS (SELECT idx, ln({_sql_model("good")}) - ln({_sql_model("bad")}) AS d FROM a JOIN two USING (bc) JOIN oab USING (ab) JOIN ob ON ob.b = a.b JOIN oc ON oc.c = a.c, oall),
e AS (SELECT host, path, sum(d) / count(*) AS score FROM t JOIN l USING (idx) GROUP BY host, path),
g AS (SELECT floor(least(greatest(score, -{FAR}), {FAR}) * {BINS}) AS bin, sum(n) FILTER (rv = 'allow') AS good, sum(n) FILTER (rv = 'block') AS bad FROM e JOIN f USING (host, path) WHERE rv IS NOT NULL AND apart GROUP BY 1),
w AS (SELECT bin, sum(good) OVER () AS goods, sum(bad) OVER () AS bads, coalesce(sum(good) OVER p, 0) / greatest(1, coalesce(sum(good) OVER (), 0)) + 1 - coalesce(sum(bad) OVER p, 0) / greatest(1, coalesce(sum(bad) OVER (), 0)) AS error
      FROM g WINDOW p AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT CASE WHEN max(goods) > 0 AND max(bads) > 0 THEN arg_min(bin, (round(error, 12), bin)) / {BINS}.0 ELSE 0 END AS least_score FROM w)
SELECT page_id, host, path, rule, CASE WHEN rv IS NOT NULL THEN rv WHEN score >= coalesce(least_score, 0) THEN 'allow' ELSE 'block' END AS verdict, round(score, 6) AS score
FROM h JOIN f USING (host, path) JOIN e USING (host, path), z
"""
