"""What a question is about: domains, facts of foreign drivers, operational rewrites, training rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.questions import anonymise_training
from quarry.functions.text import article_number, code, intent, procedure, search_form

# Domain per intent, and vocabularies over the folded question.
DOMAIN = {"codigo": "infracao", "artigo": "ctb", "pop": "pop", "infracao": "infracao", "natureza_pmsc": "fato_pmsc", "consulta_geral": "ctb"}
OPERATION_WORDS = (
    r"\b(?:baculejo|revista pessoal|fundada suspeita|abordar|abordagem|prisao|conducao|uso progressivo|violencia domestica|maria da penha)\b"
)
MESSAGE_AT_WHEEL = (
    r"\b(?:zap|whats(?:app)?|mensagem)\b.*\b(?:volante|dirig|veiculo|carro|moto)\b|\bvolante\b.*\b(?:zap|whats(?:app)?|mensagem)\b"
)
QUARREL = r"\b(?:briga|desentendimento|ameaca|furto|roubo|agressao)\b"
QUARREL_PLACE = r"\b(?:natureza|fato|ocorrencia|vizinh|famil|rua|local)\w*\b"
INCIDENT_WORDS = r"\b(?:som alto|perturbacao|pancadao|vias? de fato|perda de documentos?|acidente com vitima)\b"
GENERIC_TERM = r"^(?:sem|nao|\d+)$"
# Fixed values: (all patterns that must hold, the words to search for instead).
WEIGHT_REWRITES = (
    (("nota|documento fiscal", "sem|ausen|nao", "kg|peso"), "documento fiscal ausência peso kg pesagem documento substituto"),
    (("carreta|cavalo",), "PBTC caminhão trator semirreboque peso combinado"),
    ((r"5\s*(?:%|por cento)|cinco por cento",), "tolerância PBT PBTC equipamento pesagem"),
    (("tandem",), "peso bruto conjunto eixos tandem"),
    (("quem|respons|infrator", "embarcador|transportador"), "infrator responsabilidade embarcador transportador excesso peso"),
    (("cmt|capacidade maxima de tracao", r"mil|1000|1\.000|acima"), "CMT acima 1000 excesso infração gravíssima"),
)
FACT_REWRITES = (
    ((r"\b(?:som alto|pancadao|barulho|perturb.*sossego)\b",), "perturbação do trabalho ou sossego alheios"),
    ((r"\b(?:perdeu|perda|extravi).*(?:doc|obj)|\bdoc(?:s|umento)?.*(?:perd|extravi)",), "perda de documentos ou objetos"),
    ((r"\b(?:acid|acidente|batida|colisao).*(?:dano|mater)",), "acidente de trânsito apenas danos materiais"),
    ((r"\b(?:briga|vias?\s+(?:de\s+)?fat)",), "vias de fato"),
)
# What tells of a suicide, and of a crash with people hurt.
SUICIDE = (
    r"\bsuic|\b(?:tent|quer|quis|ia)\w*\s+(?:se\s+)?matar|tirar\s+a?\s*propria\s+vida|acabar\s+com\s+a?\s*propria\s+vida"
)
CRASH_WITH_HURT = (
    r"\b(?:bateu|batida|colis|acid)\w*.*\b(?:ferid|feriu|machuc|lesion|vitima)\w*|"
    r"\b(?:ferid|feriu|machuc|lesion|vitima)\w*.*\b(?:carro|veiculo|transito|acidente)\b"
)
SUICIDE_FACTS = ("Suicídio",)
CRASH_FACTS = ("Acidente de trânsito (Com pessoa ferida ou morta)", "Lesão corporal culposa em acidente de trânsito")
EMPTY_FACT_QUESTION = r"^(?:fato|fatos|lista|natureza|potencial|ocorrencia)$"


def identified(c: Column) -> Column:
    """Names a code, an article or a procedure."""
    return code(c).isNotNull() | article_number(c).isNotNull() | procedure(c).isNotNull()


def domain(c: Column) -> Column:
    """struct(domain, confidence, signal) of a question: identifiers, then vocabularies, then the intent (Q07)."""
    text, found = search_form(c), intent(c)
    by_intent = F.coalesce(*[F.when(found["intent"] == k, v) for k, v in DOMAIN.items()])

    def as_domain(name: Column | str, sure: Column | float, signal: str) -> Column:
        return F.struct(
            (F.lit(name) if isinstance(name, str) else name).alias("domain"),
            (F.lit(sure) if isinstance(sure, float) else sure).alias("confidence"), F.lit(signal).alias("signal"),
        )

    return (
        F.when(identified(c), as_domain(by_intent, found["confidence"], "identifier"))
        .when(text.rlike(OPERATION_WORDS), as_domain("pop", 0.88, "operation"))
        .when(text.rlike(MESSAGE_AT_WHEEL), as_domain("infracao", 0.88, "slang"))
        .when(text.rlike(QUARREL) & text.rlike(QUARREL_PLACE), as_domain("fato_pmsc", 0.86, "incident"))
        .when(text.rlike(INCIDENT_WORDS), as_domain("fato_pmsc", 0.86, "incident"))
        .otherwise(as_domain(by_intent, found["confidence"], "intent"))
    )


def resolved_domain(c: Column, predicted: Column, confidence: Column, least: float = 0.75) -> Column:
    """domain(), or a model's prediction where the rules are unsure (0.6 at most), name no identifier, and the model is
    sure enough (Q08). A null prediction leaves the rules' answer."""
    own = domain(c)
    taken = ~identified(c) & (own["confidence"] <= 0.6) & F.coalesce(confidence >= least, F.lit(False)) & predicted.isNotNull()
    other = F.struct(predicted.alias("domain"), confidence.cast("double").alias("confidence"), F.lit("model").alias("signal"))
    return F.when(taken, other).otherwise(own)


def foreign_facts(c: Column) -> Column:
    """What a question says of a foreign driver, null where it says nothing (Q16).

    struct(licence, permit_shown, vehicle, insured, status). Questions that name a code or an article say nothing.
    """
    q = F.trim(F.regexp_replace(F.regexp_replace(search_form(c), r"[^a-z0-9\s-]", " "), r"\s+", " "))
    told = (q != "") & ~q.rlike(r"\b\d{3}-?\d{2}\b") & ~q.rlike(r"\bart(?:igo)?\s*\d+")

    def says(pattern: str) -> Column:
        return told & q.rlike(pattern)

    return F.struct(
        F.when(says(r"\b(?:venc|vencid|expir)\w*\b"), "vencida")
        .when(says(r"\b(?:sem|nao)\s+(?:carteira|habilit|cnh|document)\w*"), "nao_apresentada")
        .when(says(r"\b(?:habilit|carteira|document)\w*\s+(?:valid|regular)\w*"), "valida").alias("licence"),
        F.when(says(r"\bpid\b"), True).alias("permit_shown"),
        F.when(says(r"\b(?:carro|veiculo|caminhao|moto)\s+(?:estrang|paragu|argent|urug)\w*"), "estrangeiro").alias("vehicle"),
        F.when(says(r"\bsem\s+(?:seguro|carta verde)\b"), False).alias("insured"),
        F.when(says(r"\b(?:turist|visitant)\w*\b"), "visitante").when(says(r"\bresident\w*\b"), "residente").alias("status"),
    )


def _rewritten(c: Column, rules: tuple) -> Column:
    text, out = search_form(c), c
    for patterns, words in reversed(rules):
        holds = F.lit(True)
        for p in patterns:
            holds = holds & text.rlike(p)
        out = F.when(holds, words).otherwise(out)
    return out


def weight_question(c: Column) -> Column:
    """The words to search the weight rules for (K24). Questions are read up to 500 letters."""
    return _rewritten(F.left(F.trim(c), F.lit(500)), WEIGHT_REWRITES)


def fact_question(c: Column) -> Column:
    """The words to search the facts for."""
    return _rewritten(c, FACT_REWRITES)


def fact_shortcuts(c: Column) -> Column:
    """Facts that a question means whatever its words score."""
    text = search_form(c)
    none = F.array().cast("array<string>")
    return F.when(text.rlike(SUICIDE), F.array(*map(F.lit, SUICIDE_FACTS))).when(
        text.rlike(CRASH_WITH_HURT), F.array(*map(F.lit, CRASH_FACTS))
    ).otherwise(none)


def generic(terms: Column) -> Column:
    """None of the terms says anything: negations and numbers only, or no terms at all."""
    return F.forall(terms, lambda x: x.rlike(GENERIC_TERM))


def training_row(c: Column, predicted: Column) -> Column:
    """struct(question, question_hash, domain, confidence, signal) without personal data, for supervised training."""
    plain = anonymise_training(c)
    return F.struct(
        plain.alias("question"), F.sha2(F.lower(plain), 256).alias("question_hash"), predicted["domain"].alias("domain"),
        predicted["confidence"].alias("confidence"), predicted["signal"].alias("signal"),
    )
