"""From upstream rule lists to one normalised rule table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import slugify

#: Replacement type by category and subcategory.
REPLACEMENTS = {
    ("secret", "aws"): "faker_aws_key", ("secret", "github"): "faker_github_pat", ("secret", "gitlab"): "faker_api_key",
    ("secret", "stripe"): "faker_api_key", ("secret", "sendgrid"): "faker_api_key", ("secret", "slack"): "faker_api_key",
    ("secret", "openai"): "faker_api_key", ("secret", "anthropic"): "faker_api_key", ("secret", "jwt"): "faker_jwt",
    ("secret", "private-key"): "faker_api_key", ("secret", "db-conn"): "faker_db_conn", ("secret", "url-cred"): "faker_url_cred",
    ("secret", "npm"): "faker_api_key", ("secret", "pypi"): "faker_api_key", ("secret", "telegram"): "faker_api_key",
    ("secret", "generic"): "faker_api_key", ("pii", "email"): "faker_email", ("pii", "phone"): "faker_phone", ("pii", "ssn"): "faker_ssn",
    ("pii", "cc"): "faker_cc_luhn", ("pii", "iban"): "faker_iban", ("pii", "uk-nin"): "generic_random", ("pii", "pl-pesel"): "generic_random",
    ("pii", "fr-insee"): "generic_random", ("pii", "de-taxid"): "generic_random", ("pii", "address"): "generic_random",
    ("infra", "ipv4"): "passthrough", ("infra", "uuid"): "faker_uuid", ("infra", "url-cred"): "faker_url_cred",
}

#: Vendor literals that make a pattern highly specific.
VENDOR_LITERALS = """
AKIA AGPA AIDA AROA AIPA ANPA ANVA ASIA A3T ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- glptt- GR1348941 sk-ant-api sk-ant-admin
sk_test sk_live sk_prod rk_test rk_live rk_prod SG. xoxb- xapp- xoxe. ops_eyJ AGE-SECRET-KEY-1 A3- eyJ pypi-AgEI pypi-AgEN npm_ dapi
dp.pt. pscale_tkn_ pscale_oauth_ pscale_pw_ PMAK- NRAK- NRJS- AIza glc_ glsa_ hf_ api_org_ dop_v1_ LTAI CLOJARS_ dnkey- AKC fo1_ fio-u-
FLWSECK FLWPUBK pplx- pnu_ sgp_ shpat_ shpca_ shppa_ shpss_ squ_ tfp_ rdme_ rubygems_ tk-us- ico- lin_api_ hubspot pat- EZAK EZTK
xkeysib- hvs. b. yandex y1_ AQVN YCA xoxp- xoxa- ACC_ acc_
""".split()

#: Subcategory of a list entry by words in its name, in order.
NAME_WORDS = {
    "pii": (
        ("ssn", ("ssn", "social security")), ("email", ("email",)), ("phone", ("phone",)),
        ("cc", ("visa", "mastercard", "amex", "american express", "discover", "jcb", "credit card", "credit-card")), ("iban", ("iban",)),
    ),
    "secret": (
        ("aws", ("aws", "amazon")), ("github", ("github",)), ("gitlab", ("gitlab",)), ("stripe", ("stripe",)), ("slack", ("slack",)),
        ("sendgrid", ("sendgrid",)), ("npm", ("npm",)), ("pypi", ("pypi",)), ("telegram", ("telegram",)),
    ),
}

#: Category and subcategory of a rule by its id. All other ids are (secret, generic).
ID_CATEGORIES = {
    ("secret", "aws"): ("aws-amazon-bedrock-api-key-long-lived", "aws-amazon-bedrock-api-key-short-lived"),
    ("secret", "anthropic"): ("anthropic-admin-api-key",),
    ("secret", "openai"): ("openai-api-key",),
    ("secret", "github"): ("github-fine-grained-pat",),
    ("secret", "gitlab"): (
        "gitlab-ptt", "gitlab-rrt", "gitlab-pat-routable", "gitlab-cicd-job-token", "gitlab-deploy-token", "gitlab-feed-token", "gitlab-incoming-mail-token",
        "gitlab-kubernetes-agent-token", "gitlab-oauth-app-secret", "gitlab-runner-authentication-token", "gitlab-scim-token", "gitlab-session-cookie",
    ),
    ("secret", "stripe"): ("stripe-access-token",),
    ("secret", "slack"): (
        "slack-app-token", "slack-config-access-token", "slack-config-refresh-token", "slack-legacy-bot-token", "slack-legacy-token", "slack-legacy-workspace-token",
        "slack-user-token", "slack-webhook-url",
    ),
    ("secret", "jwt"): ("jwt-base64",),
    ("secret", "private-key"): ("private-key", "pkcs12-file", "age-secret-key"),
    ("secret", "sendgrid"): ("sendgrid-api-token",),
    ("secret", "npm"): ("npm-access-token", "npm"),
    ("secret", "pypi"): ("pypi-upload-token", "pypi_token-test"),
    ("secret", "telegram"): ("telegram-bot-api-token",),
    ("secret", "db-conn"): ("sidekiq-sensitive-url", "Cloudant URL"),
    ("infra", "generic"): ("kubernetes-secret-yaml",),
}
#: The same by the beginning of an id.
ID_PREFIXES = (
    ("np.aws.", "secret", "aws"), ("np.anthropic.", "secret", "anthropic"), ("np.github.", "secret", "github"), ("np.gitlab.", "secret", "gitlab"),
    ("np.slack.", "secret", "slack"), ("np.jwt.", "secret", "jwt"), ("np.stripe.", "secret", "stripe"), ("np.openai.", "secret", "openai"),
    ("np.postgres.", "secret", "db-conn"), ("np.mongo.", "secret", "db-conn"), ("np.odbc.", "secret", "db-conn"), ("np.http.", "infra", "url-cred"), ("np.pem.", "secret", "private-key"),
)


def replacement_type(category: Column, subcategory: Column) -> Column:
    table = F.create_map(*[F.lit(x) for (c, s), r in REPLACEMENTS.items() for x in (f"{c}|{s}", r)])
    return F.coalesce(F.try_element_at(table, F.concat_ws("|", category, subcategory)), F.lit("generic_random"))


def confidence(regex: Column) -> Column:
    """high if the pattern has a vendor's literal, else medium."""
    words = F.array(*[F.lit(w) for w in VENDOR_LITERALS])
    return F.when(F.exists(words, lambda w: F.contains(regex, w)), "high").otherwise("medium")


def confidence_of_categories(categories: Column) -> Column:
    return F.when(F.array_contains(categories, "fuzzy"), "medium").otherwise("high")


def severity(conf: Column) -> Column:
    return F.when(conf == "high", "high").otherwise("medium")


def subcategory_of_name(name: Column, category: Column) -> Column:
    low, out = F.lower(name), None
    for kind, table in NAME_WORDS.items():
        for sub, words in table:
            hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
            test = ((category == "pii") if kind == "pii" else (category != "pii")) & hit
            out = F.when(test, sub) if out is None else out.when(test, sub)
    return out.otherwise("generic")


def category_of_id(rule_id: Column) -> Column:
    """struct(category, subcategory) of an id, else by its prefix, else (secret, generic)."""
    pair = lambda c, s: F.struct(F.lit(c).alias("category"), F.lit(s).alias("subcategory"))
    out = F.when(rule_id.isNull(), pair("secret", "generic"))
    for (c, s), ids in ID_CATEGORIES.items():
        out = out.when(rule_id.isin(*ids), pair(c, s))
    for prefix, c, s in ID_PREFIXES:
        out = out.when(rule_id.startswith(prefix), pair(c, s))
    return out.otherwise(pair("secret", "generic"))


def list_ids(patterns: DataFrame, prefix: str = "spdb.") -> DataFrame:
    """patterns(pos, name) with id: the slug of the name, and -n from the second of equal slugs on."""
    slug = slugify("name")
    rn = F.row_number().over(Window.partitionBy(slug).orderBy("pos"))
    return patterns.withColumn("id", F.concat(F.lit(prefix), slug, F.when(rn > 1, F.concat(F.lit("-"), rn.cast("string"))).otherwise("")))


def exclude(rules: DataFrame, excluded: DataFrame) -> DataFrame:
    return rules.join(excluded.select("id").distinct(), "id", "left_anti")


def allow(rules: DataFrame, allowed: DataFrame) -> DataFrame:
    """Of a list that is taken only in part: the rules whose ids are allowed."""
    return rules.join(allowed.select("id").distinct(), "id", "left_semi")


def missing_ids(rules: DataFrame, required: DataFrame) -> DataFrame:
    """Required ids that no rule has; must be empty for a valid table."""
    return required.select("id").distinct().join(rules.select("id"), "id", "left_anti")


def merge(sources: list[DataFrame]) -> DataFrame:
    """One row for each id: of the source that comes last in the list, and in it of the last position (pos)."""
    every = reduce(DataFrame.unionByName, [s.withColumn("_prio", F.lit(i)) for i, s in enumerate(sources)])
    rn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_prio"), F.desc("pos")))
    return every.withColumn("_rn", rn).where("_rn = 1").drop("_rn", "_prio")


def repeated_ids(rules: DataFrame) -> DataFrame:
    """Must be empty for a valid table."""
    return rules.groupBy("id").agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def round_robin(rules: DataFrame, limit: int) -> DataFrame:
    """limit rules, taken in turn from each source, by id."""
    rn = F.row_number().over(Window.partitionBy("source").orderBy("id"))
    return rules.withColumn("_turn", rn).orderBy("_turn", "source").limit(limit).drop("_turn").orderBy("id")


def curate(rules: DataFrame, target: int, vendors: list[str]) -> DataFrame:
    """All hand-authored and all typed rules, then generic ones of a vendor by its priority, up to the target."""
    score = F.coalesce(*[F.when(F.contains(F.lower("id"), F.lit(v)), F.lit(i)) for i, v in enumerate(vendors)])
    typed = (F.col("source") == "hand-authored") | (F.col("subcategory") != "generic")
    kind = F.when(F.col("source") == "hand-authored", 0).when(typed, 1).otherwise(2)
    ranked = rules.withColumn("_kind", kind).withColumn("_score", score)
    fixed = ranked.where("_kind < 2")
    room = F.broadcast(fixed.agg(F.greatest(F.lit(target) - F.count(F.lit(1)), F.lit(0)).alias("_room")))
    # A rule table has hundreds of rows; the rank needs all of them in one order.
    rest = ranked.where("_kind = 2 AND _score IS NOT NULL").withColumn("_rank", F.row_number().over(Window.partitionBy("_kind").orderBy("_score", "id")))
    chosen = rest.crossJoin(room).where("_rank <= _room").drop("_rank", "_room")
    return fixed.unionByName(chosen).drop("_kind", "_score").orderBy("id")


def counts_by_source(rules: DataFrame) -> DataFrame:
    return rules.groupBy("source").agg(F.count(F.lit(1)).alias("count"), F.count_if(F.size("keywords") > 0).alias("with_keywords")).orderBy("source")


def with_email_keyword(rules: DataFrame) -> DataFrame:
    """Email rules without keywords get '@'."""
    bare = (F.col("subcategory") == "email") & (F.size("keywords") == 0)
    return rules.withColumn("keywords", F.when(bare, F.array(F.lit("@"))).otherwise(F.col("keywords")))


def fixtures(rules: DataFrame) -> DataFrame:
    """(rule_id, polarity, text) of examples and negative_examples."""
    one = lambda c, p: rules.select(F.col("id").alias("rule_id"), F.lit(p).alias("polarity"), F.explode(c).alias("text"))
    return one("examples", "pos").unionByName(one("negative_examples", "neg"))


def normalise(rules: list[dict], source: str) -> list[dict]:
    """Rows of an upstream list (see sources.rules) as input of the Spark steps: position and source added."""
    return [{"pos": i, "source": source} | r for i, r in enumerate(rules)]
