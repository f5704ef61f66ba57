"""Secrets in outgoing requests: 22 ordered predicates, the first that matches names the secret."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and formats, in their order.
SECRETS = [
    ("AWS Access Key ID", r"AKIA[0-9A-Z]{16}"),
    ("AWS Secret Key", r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+=]{40}(?![A-Za-z0-9/+=])"),
    ("GitHub PAT (classic)", r"ghp_[A-Za-z0-9]{36}"),
    ("GitHub PAT (fine-grained)", r"github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}"),
    ("GitHub OAuth", r"gho_[A-Za-z0-9]{36}"),
    ("GitHub App Token", r"ghs_[A-Za-z0-9]{36}"),
    ("GitHub Refresh Token", r"ghr_[A-Za-z0-9]{36}"),
    ("GitLab PAT", r"glpat-[A-Za-z0-9\-]{20}"),
    ("npm Token", r"npm_[A-Za-z0-9]{36}"),
    ("PyPI Token", r"pypi-[A-Za-z0-9\-_]{50,}"),
    ("Slack Bot Token", r"xoxb-[0-9]{10,}-[0-9]{10,}-[A-Za-z0-9]{24}"),
    ("Slack User Token", r"xoxp-[0-9]{10,}-[0-9]{10,}-[A-Za-z0-9]{24}"),
    ("Stripe Live Key", r"sk_live_[A-Za-z0-9]{24,}"),
    ("Stripe Test Key", r"sk_test_[A-Za-z0-9]{24,}"),
    ("Google API Key", r"AIza[0-9A-Za-z\-_]{35}"),
    ("Twilio API Key", r"SK[0-9a-fA-F]{32}"),
    ("SendGrid API Key", r"SG\.[A-Za-z0-9\-_]{22}\.[A-Za-z0-9\-_]{43}"),
    ("DigitalOcean PAT", r"dop_v1_[a-f0-9]{64}"),
    ("Doppler Token", r"dp\.pt\.[A-Za-z0-9]{43}"),
    ("Discord Bot Token", r"[MN][A-Za-z\d]{23,}\.[\w-]{6}\.[\w-]{27}"),
    ("Private Key", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    ("Password in URL", r"://[^:]+:[^@]+@"),
]


def first_secret(text: Column, secrets: list[tuple[str, str]] | None = None) -> Column:
    """Name of the first rule that matches, else null. An empty list means the shipped rules."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(n)) for n, p in secrets or SECRETS])


def netloc(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))


def allowed(url: Column, domains: list[str]) -> Column:
    """The host is one of ``domains`` or below one."""
    host = netloc(url)
    hits = [(host == d.lower()) | host.endswith("." + d.lower()) for d in domains]
    out = F.lit(False)
    for h in hits:
        out = out | F.coalesce(h, F.lit(False))
    return out


def with_allowed(df: DataFrame, domains: DataFrame, url: str = "url", into: str = "allowed") -> DataFrame:
    """Adds ``into``: whether the host of ``url`` is one of ``domains`` (domain) or below one, whatever their number.

    Each distinct host is cut at its dots and its endings meet the domains in an equi-join; rows meet their host's verdict.
    """
    df = df.withColumn("_host", netloc(F.col(url)))
    parts = F.split("host", "[.]", -1)
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = df.filter("_host is not null").select(F.col("_host").alias("host")).distinct().select("host", F.explode(endings).alias("ending"))
    good = hosts.join(domains.select(F.lower("domain").alias("ending")).distinct(), "ending", "left_semi").select(F.col("host").alias("_good")).distinct()
    return df.join(good, F.col("_host") == F.col("_good"), "left").withColumn(into, F.col("_good").isNotNull()).drop("_host", "_good")


def query_values(url: Column) -> Column:
    """Decoded values of the query, without blank ones."""
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    pairs = F.filter(F.split(query, "&"), lambda p: F.locate("=", p) > 0)
    values = F.transform(pairs, lambda p: F.coalesce(F.try_url_decode(F.regexp_replace(p, "^[^=]*=", "")), F.regexp_replace(p, "^[^=]*=", "")))
    return F.filter(values, lambda v: v != "")


def first_of(texts: Column, secrets: list[tuple[str, str]] | None = None) -> Column:
    """First secret in the first of ``texts`` that has one."""
    return F.get(F.filter(F.transform(texts, lambda t: first_secret(t, secrets)), lambda n: n.isNotNull()), F.lit(0))


def valid_url(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))
