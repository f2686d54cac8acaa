"""Deterministic conversation tables derived from the driver's tables.

``conversations_from_events`` turns each ``events`` row into one dated
conversation whose messages come from three template families (normal,
negative, emerging): one day gets extra negatives and the last week gets an
emerging topic.  It is a pure projection of ``events`` (no shuffle, no
randomness), so its size grows with the source table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES — message templates (normal 7, negative 10, emerging 3)
# ---------------------------------------------------------------------------
NORMAL_CONVERSATIONS: tuple[tuple[str, ...], ...] = (
    ("Bonjour je souhaite modifier mon offre", "oui celle en cours", "d'accord merci"),
    ("Quand sera traitée ma demande", "celle du mois dernier", "ok je patiente"),
    ("Je veux des informations sur mon contrat", "oui c'est bien ça", "merci"),
    ("Pouvez-vous me rappeler", "demain matin si possible", "parfait"),
    ("J'aimerais changer mon mot de passe", "oui je confirme", "c'est bon merci"),
    ("Comment accéder à mon espace client", "je ne trouve pas le lien"),
    ("Je voudrais un conseiller", "pour parler de ma facture", "oui"),
)
NEGATIVE_CONVERSATIONS: tuple[tuple[str, ...], ...] = (
    ("C'est scandaleux personne ne me répond", "ça fait des jours que j'attends",
     "je vais porter plainte"),
    ("Ça fait trois semaines que j'attends", "toujours rien", "c'est inadmissible"),
    ("Service incompétent je vais résilier", "j'en ai assez",
     "passez-moi un responsable"),
    ("Panne depuis ce matin rien ne fonctionne", "toujours pas rétabli",
     "c'est la troisième fois ce mois"),
    ("Bug sur l'application impossible de se connecter", "j'ai tout essayé",
     "ça ne marche toujours pas"),
    ("Je suis très déçu de votre service", "la qualité a vraiment baissé"),
    ("Arnaque pure et simple remboursez-moi", "je n'ai jamais demandé ça"),
    ("Votre service est lamentable", "je vais aller voir la concurrence"),
    ("Je vais aller chez le concurrent", "vous êtes trop cher",
     "j'ai reçu une meilleure offre"),
    ("Surfacturation sur ma dernière facture", "je veux un remboursement immédiat"),
)
EMERGING_CONVERSATIONS: tuple[tuple[str, ...], ...] = (
    ("Problème avec la nouvelle mise à jour fibre", "rien ne marche depuis",
     "quand est-ce que ça sera réparé"),
    ("Depuis la migration fibre plus rien ne marche", "internet coupé",
     "c'est inadmissible"),
    ("Migration fibre catastrophique", "débit ridicule", "je veux résilier"),
)

# fixture calendar on `events` (2024-01-01 .. 2024-01-30)
SPIKE_DAY = dt.date(2024, 1, 15)
EMERGING_FROM = dt.date(2024, 1, 24)
ALL_TEMPLATES = NORMAL_CONVERSATIONS + NEGATIVE_CONVERSATIONS + EMERGING_CONVERSATIONS


def _template_array(templates) -> Column:
    return F.array(*[F.array(*[F.lit(m) for m in conv]) for conv in templates])


def python_list_repr(arr) -> Column:
    """Render ``array<string>`` the way Python's ``str(list)`` does.

    Items containing ``'`` but no ``"`` are double-quoted, others single-quoted
    with ``'`` escaped; backslash, newline, carriage return and tab are escaped.
    """
    arr = F.col(arr) if isinstance(arr, str) else arr

    def item(x):
        esc = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        for ch, rep in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            esc = F.replace(esc, F.lit(ch), F.lit(rep))
        single = F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'"))
        double = F.concat(F.lit('"'), esc, F.lit('"'))
        return F.when(F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"')), double).otherwise(single)

    return F.concat(F.lit("["), F.array_join(F.transform(arr, item), ", "), F.lit("]"))


def conversations_from_events(events: DataFrame, form: str = "array",
                              spike_day: dt.date = SPIKE_DAY,
                              emerging_from: dt.date = EMERGING_FROM) -> DataFrame:
    """(date, conversation_id, verbatims) with one conversation per event.

    ``form``: "array" -> array<string>; "python" -> str(list) text; "json" -> JSON text.
    """
    eid = F.col("event_id")
    d = F.col("ts").cast("date")
    k = F.floor(eid / 4).cast("int")
    pick = (
        F.when((d >= F.lit(emerging_from)) & (eid % 4 == 0),
               F.element_at(_template_array(EMERGING_CONVERSATIONS), k % 3 + 1))
        .when((eid % 4 == 1) | ((d == F.lit(spike_day)) & (eid % 2 == 0)),
              F.element_at(_template_array(NEGATIVE_CONVERSATIONS), k % 10 + 1))
        .otherwise(F.element_at(_template_array(NORMAL_CONVERSATIONS), k % 7 + 1))
    )
    if form == "python":
        pick = python_list_repr(pick)
    elif form == "json":
        pick = F.to_json(pick)
    elif form != "array":
        raise ValueError(f"unknown form {form!r}")
    return events.select(
        d.alias("date"),
        F.format_string("conv_%06d", eid).alias("conversation_id"),
        pick.alias("verbatims"),
    )


def conversations_from_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conversation_id, verbatims array<string>) ordered by turn.

    The grouping key is the conversation: its message list is one output value,
    so a conversation is the unit of work here.  The sort happens inside each
    group after a partial (map-side) collect.
    """
    grouped = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("_turns")
    )
    return grouped.select(
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.transform("_turns", lambda s: s["text"]).alias("verbatims"),
    )
