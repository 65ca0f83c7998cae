"""Fetched pages: what the attempts of a connector came to, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

# Fixed values.
ATTEMPTS = 3
RETRY_STATUS = [502, 503, 504]
PASSING = ["timeout", "network"]
HTML = ["text/html", "application/xhtml+xml"]


def outcomes(attempts: DataFrame, attempts_allowed: int = ATTEMPTS, content_types: list[str] | None = HTML) -> DataFrame:
    """url, attempts, waited, body, problem of every address.

    ``attempts``: url, attempt (1, 2, ...), status, content_type, body, error
    (timeout, network or null).  The first attempt that is no passing failure
    decides, the last one allowed at the latest; before each further attempt the
    connector waits 1, 2, 4, ... seconds.  A body must be of a known type (any,
    for markdown files) and not blank.  ``problem`` is a short code: what the
    error was, ``status: n``, ``content type: x`` or ``empty``.
    """
    passing = F.coalesce(F.col("error").isin(PASSING), F.lit(False)) | F.coalesce(F.col("status").isin(RETRY_STATUS), F.lit(False))
    row = F.struct("attempt", "status", "content_type", "body", "error")
    final = F.coalesce(F.min(F.when(~passing | (F.col("attempt") >= attempts_allowed), row)), F.max(row))
    out = attempts.where(F.col("attempt") <= attempts_allowed).groupBy("url").agg(final.alias("x"))
    kind = F.lower(F.trim(F.substring_index(F.coalesce("x.content_type", F.lit("")), ";", 1)))
    body = T.strip(F.coalesce("x.body", F.lit("")))
    problem = (
        F.when(F.col("x.error").isNotNull(), F.col("x.error"))
        .when(~F.col("x.status").between(200, 299), F.concat(F.lit("status: "), F.col("x.status").cast("string")))
    )
    if content_types:
        problem = problem.when(~kind.isin(content_types), F.concat(F.lit("content type: "), F.when(kind == "", "unknown").otherwise(kind)))
    problem = problem.when(body == "", "empty")
    waited = (F.pow(F.lit(2), F.col("x.attempt") - 1) - 1).cast("long")
    return out.select("url", F.col("x.attempt").alias("attempts"), waited.alias("waited"), problem.alias("problem"), body.alias("_b")).select("url", "attempts", "waited", F.when(F.col("problem").isNull(), F.col("_b")).alias("body"), "problem")


ASKED = "url string, attempt int, status int, content_type string, body string, error string, location string"
AGENT = "Mozilla/5.0 (compatible; notes)"


def request(url: str, timeout: float = 20.0, agent: str = AGENT, most: int = 20 << 20, verify: bool = True) -> tuple:
    """status, content_type, body, error, location of one GET; redirects are told, not followed."""
    import http.client
    import ssl
    import urllib.error
    import urllib.request

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *args):
            return None

    context = ssl.create_default_context() if verify else ssl._create_unverified_context()
    opener = urllib.request.build_opener(Stay, urllib.request.HTTPSHandler(context=context))
    asked = urllib.request.Request(url, headers={"User-Agent": agent, "Accept": "text/html,application/xhtml+xml,*/*;q=0.8", "Accept-Language": "en-US,en;q=0.9"})
    try:
        try:
            got = opener.open(asked, timeout=timeout)
        except urllib.error.HTTPError as e:
            got = e
        with got:
            kind = got.headers.get("Content-Type")
            raw = got.read(most + 1)
            if len(raw) > most:
                return got.status, kind, None, "too long", None
            charset = got.headers.get_content_charset() or "utf-8"
            try:
                body = raw.decode(charset, "replace")
            except LookupError:
                body = raw.decode("utf-8", "replace")
            return got.status, kind, body, None, got.headers.get("Location")
    except TimeoutError:
        return None, None, None, "timeout", None
    except (OSError, http.client.HTTPException, ValueError) as e:  # urllib's errors are of these
        late = isinstance(getattr(e, "reason", None), TimeoutError)
        return None, None, None, "timeout" if late else "network", None


def asked(addresses: DataFrame, attempts: int = ATTEMPTS, wait: float = 1.0, **how) -> DataFrame:
    """Every attempt (ASKED) at every distinct address: passing failures are tried again after 1, 2, 4, ... times ``wait`` seconds.

    Addresses are asked by the tasks; a lost task asks its addresses again.
    """
    import time
    from collections.abc import Iterator

    import pandas as pd

    names = [f.split()[0] for f in ASKED.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for url in f["url"]:  # a frame for each address, so that bodies do not pile up
                rows = []
                for k in range(1, attempts + 1):
                    status, kind, body, error, location = request(url, **how)
                    rows.append((url, k, status, kind, body, error, location))
                    if not (error in PASSING or status in RETRY_STATUS) or k == attempts:
                        break
                    time.sleep(wait * 2 ** (k - 1))
                yield pd.DataFrame(rows, columns=names).astype({"status": "Int32", "attempt": "int32"})

    return addresses.select("url").distinct().mapInPandas(run, ASKED)


def fetched(addresses: DataFrame, hops: int = 5, refusal=U.refusal, attempts: int = ATTEMPTS, wait: float = 1.0, content_types: list[str] | None = HTML, **how) -> DataFrame:
    """url, final_url, redirects, attempts, waited, body, problem of every distinct address (a column url).

    Each round asks the addresses that are left, after ``refusal`` has judged
    them, first ones and targets of redirects alike; a round's answers are kept, so nothing
    is asked twice.  ``problem`` is as in ``outcomes``, ``refused: ...``, or
    ``redirects`` for more than ``hops``.
    """
    from ..scratch import kept

    now = addresses.select("url").where("url is not null").distinct().select("url", F.col("url").alias("final_url"))
    told = None
    for hop in range(hops + 1):
        now = now.withColumn("_refused", refusal(F.col("final_url")))
        good = now.where("_refused is null").drop("_refused")
        tries = kept(asked(good.select(F.col("final_url").alias("url")), attempts, wait, **how), "asked")
        moved = F.col("status").isin(301, 302, 303, 307, 308) & F.col("location").isNotNull()
        ended = outcomes(tries.where(~F.coalesce(moved, F.lit(False))), attempts, content_types).withColumnRenamed("url", "final_url")
        last = tries.where(moved).select(F.col("url").alias("final_url"), U.resolved(F.col("url"), F.col("location")).alias("next"))
        done = good.join(ended, "final_url").where(F.lit(True)).join(last.select("final_url"), "final_url", "left_anti")
        none = [F.lit(0).alias("attempts"), F.lit(0).cast("long").alias("waited"), F.lit(None).cast("string").alias("body")]
        refused = now.where("_refused is not null").select("final_url", "url", *none, F.concat(F.lit("refused: "), "_refused").alias("problem"))
        found = done.select("final_url", "url", "attempts", "waited", "body", "problem").unionByName(refused)
        now = good.join(last, "final_url")
        if hop == hops:
            found = found.unionByName(now.select("final_url", "url", *none, F.lit("redirects").alias("problem")))
        found = found.withColumn("redirects", F.lit(hop))
        told = found if told is None else told.unionByName(found)
        now = now.select("url", F.col("next").alias("final_url"))
        if hop == hops or now.isEmpty():
            break
    return told.select("url", "final_url", "redirects", "attempts", "waited", "body", "problem")
