"""Text signals over prompts, documents, conversations and project files."""

from pyspark.sql import functions as F

from searchloom.operators import tagging as t
from searchloom.plans.registry import query
from searchloom.plans.tables import load_view, with_views


def _re2(p: str) -> str:
    return "(?i)" + p.replace(r"\/", "/")


def _any(x: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{_re2(p)}')" for p in patterns) + ")"


CLEANED = "text"
for _p in (*t.RECOVERY_NEGATIONS, *t.RECOVERY_HYPOTHETICALS):
    CLEANED = f"regexp_replace({CLEANED}, '{_re2(_p)}', '', 'g')"


@query(
    "j1_recovery_signal",
    with_views("prompts")
    + f"SELECT text_id, {_any('c', t.RECOVERY)} AND {_any('c', t.RECOVERY_OBSERVED)} AS recovery FROM (SELECT text_id, {CLEANED} AS c FROM prompts) p",
)
def j1(spark, sf):
    return t.recovery_signal(load_view(spark, sf, "prompts")).select("text_id", "recovery")


FILE_TEXT = "name || chr(10) || type"
USABLE = "(size > 0 AND trim(content) <> '')"


@query(
    "j2_review_signal",
    with_views("project_files")
    + f"""SELECT file_id, {_any("project_text || chr(10) || content", t.DEPLOYED)} OR ({_any("project_text", t.REVIEW_DATA)} AND {_any("project_text", t.REVIEW_AVAILABLE)})
      OR {_any("content", t.REVIEW_DATA)} OR ({USABLE} AND {_any(FILE_TEXT, t.REVIEW_FILES)}) AS review FROM project_files""",
)
def j2(spark, sf):
    return load_view(spark, sf, "project_files").select("file_id", t.review_signal().alias("review"))


TAGS = ", ".join(f"{USABLE} AND {_any('whole', p)} AS {s}" for s, p in t.SOURCES.items())


@query(
    "j3_evidence_sources",
    with_views("project_files")
    + f"""SELECT project_id, bool_or({USABLE}) AS files, bool_or(gsc) AS gsc, bool_or(ga4) AS ga4, bool_or(crm) AS crm,
      bool_or(deployment) OR bool_or({_any("project_text", t.SOURCES["deployment"])}) AS deployment
    FROM (SELECT *, {TAGS} FROM (SELECT *, {FILE_TEXT} || chr(10) || content AS whole FROM project_files) w) f GROUP BY project_id""",
)
def j3(spark, sf):
    return t.evidence_availability(t.source_tags(load_view(spark, sf, "project_files")))
