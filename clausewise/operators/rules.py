"""Table-driven policy rules.

A check is data: (rule_id, check_id, rule_name, severity, message,
keywords[], document_types[]).  A document violates a check when the check
applies to its type and none of the keywords occurs in the lower-cased text.
The built-in checks are a literal, so the per-document test is a narrow
projection; a rule table of the caller's, of any size, is grouped by document type
and joined on the type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.functions.text import explode_rows, let
from clausewise.functions.violations import empty_violations, violation

RULE_TYPE = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("check_id", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
    T.StructField("document_types", T.ArrayType(T.StringType())),
])

# Fixed values (must equal the reference's rule registry).  The date check is
# reported under the registry rule id POLICY_001, as the reference does; its
# own id POLICY_002 is kept in check_id.
RULES = [
    ("CONTRACT_001", "CONTRACT_001", "Contract Termination Clause", "high",
     "Contract missing termination clause",
     ["termination", "terminate", "end of agreement", "contract end"],
     ["contract", "agreement"]),
    ("HR_001", "HR_001", "HR Manager Approval", "medium",
     "HR form missing manager approval field",
     ["manager approval", "approved by", "signature", "manager sign"],
     ["hr_form", "hr_document"]),
    ("POLICY_001", "POLICY_001", "Policy Version", "medium",
     "Policy document missing version number",
     ["version", "v.", "v "],
     ["policy", "policy_document"]),
    ("POLICY_001", "POLICY_002", "Policy Version", "medium",
     "Policy document missing effective date",
     ["effective date", "date:", "dated", "as of"],
     ["policy", "policy_document"]),
    ("INVOICE_001", "INVOICE_001", "Invoice Tax ID", "high",
     "Invoice missing tax identification number",
     ["tax id", "tax identification", "tin", "ein", "vat"],
     ["invoice", "bill"]),
]
WILDCARD_TYPE = "all"
CHECKS = "_checks"   # column with the checks that apply to a document


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, RULE_TYPE)


def _rules_literal() -> Column:
    """The built-in checks as an array column."""
    return F.array(*[
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) if not isinstance(v, list)
                   else F.array(*[F.lit(x) for x in v]).cast(f.dataType).alias(f.name)
                   for v, f in zip(row, RULE_TYPE.fields)])
        for row in RULES
    ])


def with_checks(docs: DataFrame, doc_type: Column, rules: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """`docs` with the checks of its type and of the wildcard in CHECKS, in
    (rule_id, check_id) order, each with its policy's text (E1: a left join on
    the rule id; of several policies with one id the last stored, else the
    greatest text, counts)."""
    if policies is not None:
        stored = F.col("stored_at") if "stored_at" in policies.columns else F.lit(None).cast("timestamp")
        texts = policies.groupBy("policy_id").agg(F.max(F.struct(stored.alias("at"), F.col("content"))).alias("_p"))
        rules = rules.join(texts, rules["rule_id"] == texts["policy_id"], "left").withColumn("policy_snippet", F.col("_p.content"))
    else:
        rules = rules.withColumn("policy_snippet", F.lit(None).cast("string"))
    check = F.struct("rule_id", "check_id", *[f.name for f in RULE_TYPE.fields[2:]], "policy_snippet")
    by_type = (rules.withColumn("_type", F.explode(F.array_distinct("document_types")))
               .groupBy("_type").agg(F.sort_array(F.collect_list(check)).alias("_own")))
    wild = by_type.filter(F.col("_type") == WILDCARD_TYPE).agg(F.flatten(F.collect_list("_own")).alias("_wild"))  # one row
    own = by_type.filter(F.col("_type") != WILDCARD_TYPE)
    joined = docs.withColumn("_doc_type", F.coalesce(doc_type, F.lit("unknown"))).join(own, F.col("_doc_type") == F.col("_type"), "left").crossJoin(wild)
    both = F.sort_array(F.array_distinct(F.concat(F.coalesce("_own", F.filter("_wild", lambda _: F.lit(False))), "_wild")))
    return joined.withColumn(CHECKS, both).drop("_doc_type", "_type", "_own", "_wild")


def applicable(rules_arr: Column, doc_type: Column) -> Column:
    """Checks whose document_types contain the type or the wildcard."""
    t = F.coalesce(doc_type, F.lit("unknown"))
    return F.filter(rules_arr, lambda r: F.array_contains(r["document_types"], t)
                    | F.array_contains(r["document_types"], WILDCARD_TYPE))


def policy_violations(text: Column, doc_type: Column, checks: Column | None = None) -> Column:
    """array<violation>, span 0..len(text), in check order.  `checks`:
    the document's own array (see `with_checks`); None for the built-in ones."""
    src = F.coalesce(text, F.lit(""))

    def failed(found: Column) -> Column:
        def check(b: Column) -> Column:
            # b = (lower-cased text, text length), bound once per document
            bad = F.filter(found, lambda r: ~F.exists(r["keywords"], lambda k: F.contains(b["low"], k)))
            return F.transform(bad, lambda r: violation(
                scanner="policy", type="policy_violation", rule_id=r["rule_id"], check_id=r["check_id"],
                rule_name=r["rule_name"], severity=r["severity"], message=r["message"],
                span_start=F.lit(0), span_end=b["len"]))
        # only documents with an applicable rule pay for lower-casing the text
        return F.when(F.size(found) > 0, let(F.struct(F.lower(src).alias("low"), F.length(src).alias("len")),
                                              check)).otherwise(empty_violations())

    if checks is not None:
        return failed(checks)
    # the type is bound once: it is read inside per-rule lambdas
    return let(F.coalesce(doc_type, F.lit("unknown")), lambda t: failed(applicable(_rules_literal(), t)))


def rules_checked(doc_type: Column, checks: Column | None = None) -> Column:
    """Number of distinct registry rules applied to the type."""
    if checks is not None:
        return F.size(F.array_distinct(F.transform(checks, lambda r: r["rule_id"])))
    return let(F.coalesce(doc_type, F.lit("unknown")), lambda t: F.size(F.array_distinct(
        F.transform(applicable(_rules_literal(), t), lambda r: r["rule_id"]))))


def apply_policy_rules(docs: DataFrame, type_col: str = "document_type", id_col: str = "doc_id",
                       text_col: str = "text", rules: DataFrame | None = None) -> DataFrame:
    """One row per failed check."""
    if rules is not None:
        docs = with_checks(docs, F.col(type_col), rules)
    v = policy_violations(F.col(text_col), F.col(type_col), None if rules is None else F.col(CHECKS))
    return (explode_rows(docs, [id_col, type_col], v, "seq", "v")
            .select(id_col, type_col, F.col("seq").cast("int").alias("seq"), "v.rule_id", "v.check_id",
                    "v.rule_name", "v.severity", "v.message", "v.span_start", "v.span_end"))


def rules_for_types(types: DataFrame, rules: DataFrame, type_col: str = "document_type") -> DataFrame:
    """R1 as a join.  Each document row is expanded to the two keys it can
    match (its own type and the wildcard), and joined on equality with the
    rules exploded by type."""
    exploded = rules.select("*", F.explode("document_types").alias("_t")).drop("document_types")
    keyed = types.withColumn("_k", F.explode(F.array(F.coalesce(F.col(type_col), F.lit("unknown")),
                                                     F.lit(WILDCARD_TYPE))))
    return (keyed.join(exploded, F.col("_k") == F.col("_t"), "inner")
            .drop("_k", "_t"))
