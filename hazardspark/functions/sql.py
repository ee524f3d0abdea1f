"""Functions for users of SQL: scalar ones that Catalyst inlines, and table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from hazardspark import rules
from hazardspark.functions.text import WORD
from hazardspark.operators import gazetteer as gz

_URL = r"(?i)(https?://\S+|www\.\S+)"
_SCRIPTS = {"hi": (0x0900, 0x097F), "bn": (0x0980, 0x09FF), "gu": (0x0A80, 0x0AFF), "ta": (0x0B80, 0x0BFF)}
_FIRST = "ascii(regexp_extract(t, r'([\\x{0900}-\\x{097F}\\x{0980}-\\x{09FF}\\x{0A80}-\\x{0AFF}\\x{0B80}-\\x{0BFF}])', 1))"

SCALARS = {
    "tags_of(t STRING) RETURNS ARRAY<STRING>": f"array_distinct(transform(regexp_extract_all(t, r'#({WORD}+)', 1), x -> lower(x)))",
    "mentions_of(t STRING) RETURNS ARRAY<STRING>": f"transform(regexp_extract_all(t, r'@({WORD}+)', 1), x -> lower(x))",
    "urls_of(t STRING) RETURNS ARRAY<STRING>": f"regexp_extract_all(t, r'{_URL}', 1)",
    "normalized_text(t STRING) RETURNS STRING": f"lower(trim(regexp_replace(regexp_replace(regexp_replace(t, r'{_URL}', ' '), r'[#@]({WORD}+)', '$1'), r'\\s+', ' ')))",
    "script_of(t STRING) RETURNS STRING": "CASE " + " ".join(f"WHEN {_FIRST} BETWEEN {a} AND {b} THEN '{name}'" for name, (a, b) in _SCRIPTS.items()) + " ELSE 'en' END",
    "metres_between(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": f"2 * {rules.EARTH_RADIUS_M}D * asin(sqrt(least(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2), 1D)))",
    "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "CASE WHEN size(a) = size(b) THEN greatest(-1D, least(1D, aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x))) ELSE 0D END",
}
_FEATURES = "TABLE(normalized STRING, text_hash STRING, language STRING, hashtags ARRAY<STRING>, mentions ARRAY<STRING>, urls ARRAY<STRING>)"


def register(spark: SparkSession) -> None:
    """The scalar functions, and text_features(t), a table of one row for LATERAL joins. All are expressions that Catalyst inlines: no Python runs."""
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION text_features(t STRING) RETURNS {_FEATURES} RETURN SELECT normalized_text(t), sha2(normalized_text(t), 256), script_of(t), tags_of(t), mentions_of(t), urls_of(t)")


def register_places(spark: SparkSession, gazetteer: DataFrame, name: str = "places_in", most: int = 2_000_000) -> None:
    """places_in(text): a row (name, kind, words, at) for each place that a text names, by place in the text, for LATERAL joins.

    Names of one to three words, an ambiguous one only with a capital on each word, as in gazetteer.named_places, which picks one of them by a join instead. The names are given to every worker, so
    a gazetteer of more than `most` names is refused: use named_places for those. Null and empty texts name nothing.
    """
    rows = gazetteer.select("name", "kind", "ambiguous").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} names: join with gazetteer.named_places instead")
    known = spark.sparkContext.broadcast({r.name: (r.kind, bool(r.ambiguous)) for r in rows if r.name is not None and len(r.name) >= gz.SHORTEST and r.name not in rules.PLACE_STOPWORDS})

    @udtf(returnType="name string, kind string, words int, at int")
    class Places:
        def eval(self, text: str):
            words = _words(text or "")
            for at in range(len(words)):
                for n in (1, 2, 3):
                    said = words[at : at + n]
                    kind, ambiguous = known.value.get(" ".join(said).lower(), (None, False))
                    if len(said) == n and kind and not (ambiguous and not all(w[0].isupper() for w in said)):
                        yield " ".join(said).lower(), kind, n, at

    spark.udtf.register(name, Places)


def _words(text: str) -> list[str]:
    """Runs of letters and the marks on them."""
    import regex

    return regex.findall(r"[\p{L}\p{M}]+", text)
