"""Batches of analysed pieces: scores, status, indicators, findings and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Findings as (key, label, severity), in the order of their rules.
FINDINGS = (
    ("format_not_allowed", "Formato no permitido", "error"),
    ("dimensions_invalid", "Dimensiones no válidas", "alerta"),
    ("file_size_invalid", "Peso del archivo excedido", "alerta"),
    ("logo_missing", "Logo no detectado", "alerta"),
    ("logo_warning", "Observación en detección de logo", "alerta"),
    ("logo_position_error", "Problemas de posición del logo", "error"),
    ("logo_size_error", "Problemas de tamaño del logo", "error"),
    ("text_outside_safe_area", "Texto fuera del área segura", "error"),
    ("text_inside_safe_area", "Texto dentro del área segura", "ok"),
    ("logo_container_missing", "Contenedor del logo no detectado", "alerta"),
    ("ocr_corrections", "Observaciones OCR (texto corregido)", "alerta"),
    ("ocr_low_confidence", "Baja confianza OCR", "alerta"),
)
STATES = ("subiendo", "analizando", "pendiente", "error", "listo")
#: Item columns that a source may lack; they count as null.
OPTIONAL = {"logo_warning": "boolean", "logo_position_status": "string", "logo_size_status": "string", "logo_container_detected": "boolean", "raw_text": "string", "corrected_text": "string"}


def _with_optional(items: DataFrame) -> DataFrame:
    return items.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in OPTIONAL.items() if c not in items.columns])


def _clamp(value: Column) -> Column:
    """Whole per cent from 0 to 100; null stays null, which greatest and least would skip."""
    return F.when(value.isNotNull(), _bounded(value))


def _bounded(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(value).cast("int")))


def technical_score() -> Column:
    """Share of the three technical checks that pass, in per cent."""
    passed = sum(F.col(c).cast("int") for c in ("format_allowed", "dimensions_valid", "file_size_valid"))
    return F.round(passed * 100 / F.lit(3.0)).cast("int")


def blend_score(ocr_scale: int = 1) -> Column:
    """Mean of technical, layout and recognition scores, as far as they exist.

    Recognition scores run from 0 to 1; ``ocr_scale=1`` takes them as per cent all the same, 100 converts them.
    """
    parts = F.array_compact(F.array(technical_score(), _clamp(F.col("layout_score")), _clamp(F.col("ocr_score") * ocr_scale)))
    return _clamp(F.aggregate(parts, F.lit(0), lambda s, x: s + x) / F.size(parts).cast("double"))


def has_layout() -> Column:
    return F.col("layout_score").isNotNull()


def status_general() -> Column:
    """ok, alerta or error of a finished item."""
    failed = ~(F.col("format_allowed") & F.col("dimensions_valid") & F.col("file_size_valid"))
    hard = (F.coalesce("logo_position_status", F.lit("")) == "error") | (F.coalesce("logo_size_status", F.lit("")) == "error") | F.coalesce(~F.col("text_inside_safe_area"), F.lit(False))
    layout_bad = has_layout() & (hard | F.coalesce("logo_warning", F.lit(False)))
    return F.when(~F.col("format_allowed"), "error").when(failed | layout_bad, "alerta").otherwise("ok")


def cards(items: DataFrame, ocr_scale: int = 1) -> DataFrame:
    """Items with ``score_general`` and ``status_general``; unfinished ones have 0, and alerta or error by their state."""
    done = F.col("state") == "listo"
    rows = _with_optional(items)
    return rows.withColumn("score_general", F.when(done, blend_score(ocr_scale)).otherwise(0)).withColumn("status_general", F.when(done, status_general()).when(F.col("state") == "error", "error").otherwise("alerta"))


def card_indicators(items: DataFrame) -> DataFrame:
    """``item_id, safe_area, logo, text_safe_area, logo_container, overall``; unfinished items have no_aplica throughout."""
    done, layout = F.col("state") == "listo", has_layout()
    state = lambda c: F.when(done, c).otherwise("no_aplica")
    with_layout = lambda c: state(F.when(layout, c).otherwise("no_aplica"))
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    rows = cards(items)
    return rows.select(
        "item_id",
        with_layout(F.lit("ok")).alias("safe_area"),
        with_layout(F.when(flag("logo_detected"), "ok").otherwise("error")).alias("logo"),
        with_layout(F.when(flag("text_inside_safe_area"), "ok").otherwise("error")).alias("text_safe_area"),
        # the container's place and size are never emitted together, so at best it is an alert
        with_layout(F.lit("alerta")).alias("logo_container"),
        state(F.col("status_general")).alias("overall"),
    )


def item_findings(items: DataFrame) -> DataFrame:
    """``batch_id, item_id, ..., finding`` for every finding of every finished item; finding is (key, label, severity)."""
    rows = _with_optional(items).where("state = 'listo'")
    layout = has_layout()
    raw, corrected = F.trim("raw_text"), F.trim("corrected_text")
    rules = (
        ~F.col("format_allowed"),
        ~F.col("dimensions_valid"),
        ~F.col("file_size_valid"),
        layout & ~F.coalesce("logo_detected", F.lit(False)),
        layout & F.col("logo_warning"),
        layout & (F.col("logo_position_status") == "error"),
        layout & (F.col("logo_size_status") == "error"),
        layout & ~F.col("text_inside_safe_area"),
        layout & F.col("text_inside_safe_area"),
        layout & ~F.col("logo_container_detected"),
        (raw != "") & (corrected != "") & (raw != corrected),
        (F.col("ocr_avg") > 0) & (F.col("ocr_avg") < 0.7),
    )
    found = [F.when(rule, F.struct(F.lit(k).alias("key"), F.lit(label).alias("label"), F.lit(s).alias("severity"))) for rule, (k, label, s) in zip(rules, FINDINGS, strict=True)]
    return rows.withColumn("finding", F.explode(F.array_compact(F.array(*found))))


def batch_findings(items: DataFrame) -> DataFrame:
    """``key, label, severity, n`` over all finished items; partial counts are made before the shuffle."""
    return item_findings(items).groupBy("finding.key", "finding.label", "finding.severity").agg(F.count("*").alias("n"))


def top_findings(items: DataFrame, k: int = 6) -> DataFrame:
    return batch_findings(items).orderBy(F.desc("n"), "key").limit(k)


def batch_summary(items: DataFrame, keys: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """Counts by state and status, progress and mean score of every batch."""
    state, status = F.col("state"), F.col("status_general")
    unit = F.when(state.isin("listo", "error"), 1.0).when(state == "analizando", 0.5).when(state == "subiendo", 0.5 * (_clamp(F.coalesce("progress_percent", F.lit(0))) / F.lit(100.0))).otherwise(0.0)
    done = state == "listo"
    n = lambda c: F.count_if(c)
    out = cards(items).groupBy(*keys).agg(
        F.count("*").alias("total"),
        n(state == "pendiente").alias("pendientes"),
        n(state.isin("subiendo", "analizando")).alias("en_proceso"),
        n(done).alias("completadas"),
        n(state == "error").alias("con_error"),
        n(state.isin("listo", "error")).alias("analizadas"),
        _clamp(F.round(F.sum(unit) / F.count("*") * 100, 6)).alias("progreso_percent"),
        n(done & (status == "ok")).alias("ok"),
        n(done & (status == "alerta")).alias("alerta"),
        n(done & (status == "error")).alias("error"),
        n(done & (status != "ok")).alias("con_alertas"),
        _clamp(F.coalesce(F.avg(F.when(done, F.col("score_general"))), F.lit(0.0))).alias("score_promedio"),
    )
    return out


def filter_batch(items: DataFrame, mode: str) -> DataFrame:
    """todas, correctas, alertas or error."""
    rows, done = cards(items), F.col("state") == "listo"
    status = F.col("status_general")
    keep = {"todas": F.lit(True), "correctas": done & (status == "ok"), "alertas": done & (status == "alerta"), "error": (F.col("state") == "error") | (done & (status == "error"))}
    return rows.where(keep[mode])


def sort_batch(items: DataFrame, order: str, name: str = "item_id") -> DataFrame:
    """estado, nombre, score_alto or score_bajo; unfinished items come last by score; ties by name."""
    rows = cards(items)
    score = F.when(F.col("state") == "listo", F.col("score_general"))
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    keys = {"estado": [rank], "nombre": [], "score_alto": [F.desc_nulls_last(score)], "score_bajo": [F.asc_nulls_last(score)]}[order]
    return rows.orderBy(*keys, name)


# Labels and kinds that states are shown with.
STATUS_LABELS = {
    "overall": {"match": ("ok", "Coincide"), "partial_match": ("warning", "Parcial"), "ambiguous": ("warning", "Ambiguo"), "not_found": ("error", "No encontrada"), "not_executed": ("na", "No ejecutado"), "not_applicable": ("na", "No aplica"), "error": ("error", "Error")},
    "comparison": {"match": ("ok", "Coincide"), "mismatch": ("error", "Diferente"), "not_detected": ("warning", "No detectado"), "valid_empty": ("na", "Vacío válido")},
    "field": {"detected": ("ok", "Detectado"), "ambiguous": ("warning", "Ambiguo"), "not_applicable": ("na", "No aplica"), "not_detected": ("na", "No detectado")},
    "state": {"pendiente": ("na", "Pendiente"), "subiendo": ("na", "Subiendo"), "analizando": ("na", "Analizando"), "listo": ("ok", "Completado"), "error": ("error", "Error")},
}


def status_label(kind: str, status: Column) -> Column:
    """``(variant, label)`` of a status; unknown ones show themselves, empty ones a dash."""
    table = F.create_map(*[x for k, (v, name) in STATUS_LABELS[kind].items() for x in (F.lit(k), F.struct(F.lit(v).alias("variant"), F.lit(name).alias("label")))])
    other = F.struct(F.lit("na").alias("variant"), F.coalesce(F.nullif(status, F.lit("")), F.lit("—")).alias("label"))
    return F.coalesce(F.try_element_at(table, F.coalesce(status, F.lit(""))), other)


def validation_pass_count(*checks: Column) -> Column:
    """``(passed, total)`` of technical checks; null counts as failed."""
    passed = sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks), F.lit(0))
    return F.struct(passed.alias("passed"), F.lit(len(checks)).alias("total"))
