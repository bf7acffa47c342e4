"""Rule engines as column expressions: weight limits, inspection fines, foreign drivers, guided classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fines in cents and their steps.
FINE_MEDIUM, FINE_SERIOUS, FINE_GRAVEST = 13016, 19523, 29347
STEPS = ((600, 532), (800, 1064), (1000, 2128), (3000, 3192), (5000, 4256))
LAST_STEP = 5320


def excess_fine(excess: Column) -> Column:
    """Surcharge in cents for excess kilograms: per started 200 kg, at the step that the excess reaches."""
    rate = F.lit(LAST_STEP)
    for upto, cents in reversed(STEPS):
        rate = F.when(excess <= upto, cents).otherwise(rate)
    return F.when(excess <= 0, 0).otherwise(F.ceil(excess / 200) * rate).cast("long")


def traction_fine(excess: Column) -> Column:
    """struct(code, cents) for excess over the traction capacity, null without excess."""
    def out(code: str, cents: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), cents.cast("long").alias("cents"))

    return (
        F.when(excess <= 0, None)
        .when(excess <= 600, out("688-20", F.lit(FINE_MEDIUM)))
        .when(excess <= 1000, out("689-00", F.lit(FINE_SERIOUS)))
        .otherwise(out("690-40", F.ceil(excess / 500) * FINE_GRAVEST))
    )


def weight_limit(legal: Column, technical: Column, traction: Column, sign: Column, permit: Column) -> Column:
    """struct(kg, factor) of the lowest positive limit; of equal ones the first in this order counts (C11)."""
    names = ("legal", "tecnico", "cmt", "sinalizacao", "aet")
    options = [
        F.when(v > 0, F.struct(v.cast("double").alias("kg"), F.lit(i).alias("i"), F.lit(n).alias("factor")))
        for i, (n, v) in enumerate(zip(names, (legal, technical, traction, sign, permit)))
    ]
    low = F.array_min(F.array_compact(F.array(*options)))
    return F.struct(low["kg"].alias("kg"), low["factor"].alias("factor"))


def foreign_driver(licence: Column, category_ok: Column, identity_ok: Column, permit_shown: Column, pending: Column) -> Column:
    """Conditions of infraction 501-00 that hold; none while questions are pending (C16). Unknown (null) is not false."""
    found = F.array_compact(
        F.array(
            F.when(licence == "vencida", "expired").when(licence == "nao_apresentada", "no licence"),
            F.when(~category_ok, "category"),
            F.when(~identity_ok, "identity"),
            F.when(permit_shown & (licence == "nao_apresentada"), "permit only"),
        )
    )
    return F.when(pending > 0, F.array().cast("array<string>")).otherwise(found)


def guided(candidates: DataFrame, criteria: DataFrame, answers: DataFrame) -> DataFrame:
    """(case_id, code, score, contradiction): 100 less the candidate's place, +20 and -30 per answer (C14).

    candidates(case_id, code, place), criteria(code, criterion, source), answers(case_id, criterion, answer).
    """
    told = candidates.join(criteria, "code").join(answers, ["case_id", "criterion"]).where("answer in ('sim', 'nao')")
    good = (F.col("source") == "quando_autuar") == (F.col("answer") == "sim")
    sums = told.groupBy("case_id", "code").agg(F.count_if(good).alias("yes"), F.count_if(~good).alias("no"))
    out = candidates.join(sums, ["case_id", "code"], "left").na.fill(0, ["yes", "no"])
    mixed = F.max((F.col("yes") > 0) & (F.col("no") > 0))
    flags = out.groupBy("case_id").agg(mixed.alias("contradiction"))
    return out.join(flags, "case_id").select(
        "case_id", "code", (100 - F.col("place") + 20 * F.col("yes") - 30 * F.col("no")).alias("score"), "contradiction"
    )


def readiness(invalid: Column, duplicate: Column, items: Column, hit1: Column, hit3: Column) -> Column:
    """critica, atencao or pronta."""
    critical = (items <= 0) | (invalid > 0) | (duplicate > 0)
    return F.when(critical, "critica").when((hit3 < 100) | (hit1 < 90), "atencao").otherwise("pronta")


# Tolerances of scales, codes of excess, and who answers for it.
TOTAL_TOLERANCE, AXLE_TOLERANCE, AXLES_FROM_KG = 1.05, 1.125, 50_000
BOTH_CODE, TOTAL_CODE, AXLE_CODE = "683-13", "683-11", "683-12"
OWNER = "Proprietário"
OWNER_AND_OTHERS = "Proprietário pela CMT; responsabilidade pelo excesso de peso conforme o art. 257 do CTB"
CARRIER = "Transportador"
SHIPPER_AND_CARRIER = "Embarcador e transportador, solidariamente"
OPEN = "Responsabilidade a confirmar conforme o documento fiscal e o art. 257 do CTB"


def inspection(limit: Column, mode: Column, tare: Column, cargo: Column, gross: Column, weighed: Column, traction: Column,
               axles: Column, shippers: Column) -> Column:
    """struct(status, kg, limit_kg, excess, axle_excess, traction_excess, codes, cents, responsible) of a stop.

    mode is ``carga`` (tare and declared cargo), ``peso-bruto-total`` (declared gross weight) or ``balanca`` (scale, with
    tolerance). axles is an array of struct(kg, legal, technical). Without a limit or a weight the status is inconclusivo.
    """
    scale = mode == "balanca"
    kg = F.when(scale, F.when(weighed > 0, weighed)).when(mode == "carga", F.when((tare > 0) & (cargo >= 0), tare + cargo)).otherwise(F.when(gross > 0, gross))
    known = F.coalesce((limit > 0) & kg.isNotNull(), F.lit(False))
    top = F.when(scale, limit * TOTAL_TOLERANCE).otherwise(limit)
    excess = F.greatest(kg - top, F.lit(0.0))

    def over(total: Column, g: Column) -> Column:
        base = F.when(g["technical"] > 0, F.least(g["legal"], g["technical"])).otherwise(g["legal"])
        return total + F.greatest(g["kg"] - base * AXLE_TOLERANCE, F.lit(0.0))

    by_axle = F.aggregate(F.coalesce(axles, F.array().cast("array<struct<kg:double,legal:double,technical:double>>")), F.lit(0.0), over)
    axle = F.when(scale & ((limit > AXLES_FROM_KG) | (excess > 0)), by_axle).otherwise(0.0)
    pull = F.when(traction > 0, F.greatest(kg - traction, F.lit(0.0))).otherwise(0.0)
    heavy = (excess > 0) | (axle > 0)
    code_ = F.when((excess > 0) & (axle > 0), BOTH_CODE).when(excess > 0, TOTAL_CODE).when(axle > 0, AXLE_CODE)
    fine = traction_fine(pull)
    codes = F.array_compact(F.array(code_, fine["code"]))
    cents = F.when(heavy, FINE_MEDIUM + excess_fine(excess) + excess_fine(axle)).otherwise(0) + F.coalesce(fine["cents"], F.lit(0))
    status = F.when(F.size(codes) > 0, "autuavel").when(scale & (kg > limit), "dentro-tolerancia").otherwise("regular")
    who = (
        F.when(pull > 0, F.when(heavy, OWNER_AND_OTHERS).otherwise(OWNER))
        .when((F.coalesce(shippers, F.lit(0)) > 1) | (axle > 0), CARRIER)
        .when(scale, OPEN)
        .otherwise(SHIPPER_AND_CARRIER)
    )
    zero = F.lit(0.0)
    return F.struct(
        F.when(known, status).otherwise("inconclusivo").alias("status"), F.when(known, kg).alias("kg"), F.when(known, top).otherwise(limit).alias("limit_kg"),
        F.when(known, excess).otherwise(zero).alias("excess"), F.when(known, axle).otherwise(zero).alias("axle_excess"),
        F.when(known, pull).otherwise(zero).alias("traction_excess"), F.when(known, codes).otherwise(F.array().cast("array<string>")).alias("codes"),
        F.when(known, cents).otherwise(0).cast("long").alias("cents"), F.when(known & (F.size(codes) > 0), who).alias("responsible"),
    )


def axle_gaps(wanted: Column, given: Column) -> Column:
    """struct(missing, unknown): axle groups of the catalogue that lack a weight, and weighed ones it doesn't have."""
    return F.struct(F.array_except(wanted, given).alias("missing"), F.array_except(given, wanted).alias("unknown"))


def dossier_key(theme: Column, sections: Column, version: Column) -> Column:
    """Key of a cached dossier: theme, sorted sections and corpus version."""
    return F.concat_ws(":", theme, F.array_join(F.sort_array(sections), "+"), version)
