"""The practice database: 14 related tables, generated at any size.

Rows depend on their number and the seed alone (hashes, no random state), so every machine makes
the same rows and a table can be made in as many parts as there are cores.  The anomalies that the exercises
look for are there: missing measurements, assessments closed without any, more beneficiaries
than goods, places without visits or distributions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Table -> columns.  Dates are ISO text and booleans 0 or 1, as in the exercises.
SCHEMA = {
    "strutture": "id long, nome string, tipo string, paese string, regione string, letti long, data_apertura string, attiva int",
    "pazienti": "id long, codice string, sesso string, data_nascita string, regione string, sfollato int, struttura_registrazione_id long, data_registrazione string",
    "visite": "id long, paziente_id long, struttura_id long, data string, tipo string, esito string, durata_min long, operatore string",
    "diagnosi": "id long, visita_id long, codice_icd10 string, descrizione string, cronica int, gravita string",
    "prescrizioni": "id long, visita_id long, farmaco string, dose_mg double, giorni long, classe string",
    "vaccinazioni": "id long, paziente_id long, vaccino string, dose_num long, data string, struttura_id long",
    "esami_lab": "id long, visita_id long, analita string, valore double, unita string, fuori_range int",
    "progetti": "id long, nome string, paese string, donatore string, settore string, data_inizio string, data_fine string, budget_eur double, stato string",
    "siti": "id long, progetto_id long, nome string, tipo string, regione string, lat double, lon double, popolazione_stimata long, accessibile int",
    "valutazioni": "id long, sito_id long, data string, strumento string, intervistati long, completata int, responsabile string",
    "indicatori": "id long, codice string, nome string, settore string, unita string, direzione string, disaggregabile int",
    "misurazioni": "id long, valutazione_id long, indicatore_id long, valore double, baseline double, target double, qualita string",
    "distribuzioni": "id long, sito_id long, data string, articolo string, quantita long, beneficiari long, costo_unitario_eur double",
    "personale": "id long, progetto_id long, ruolo string, nazionale int, data_inizio string, data_fine string, costo_mensile_eur double",
}
#: Rows per unit of size (size 1: about 26,000 rows in all).
ROWS = {"strutture": 40, "pazienti": 2400, "visite": 7200, "diagnosi": 7200, "prescrizioni": 3600, "vaccinazioni": 500, "esami_lab": 1800, "progetti": 22, "siti": 100, "valutazioni": 300, "indicatori": 14, "misurazioni": 1100, "distribuzioni": 200, "personale": 190}
REFERENCES = [
    ("pazienti", "struttura_registrazione_id", "strutture"), ("visite", "paziente_id", "pazienti"), ("visite", "struttura_id", "strutture"),
    ("diagnosi", "visita_id", "visite"), ("prescrizioni", "visita_id", "visite"), ("vaccinazioni", "paziente_id", "pazienti"),
    ("vaccinazioni", "struttura_id", "strutture"), ("esami_lab", "visita_id", "visite"), ("siti", "progetto_id", "progetti"),
    ("valutazioni", "sito_id", "siti"), ("misurazioni", "valutazione_id", "valutazioni"), ("misurazioni", "indicatore_id", "indicatori"),
    ("distribuzioni", "sito_id", "siti"), ("personale", "progetto_id", "progetti"),
]

_CHOICES = {
    "tipo": ["ambulatorio", "ospedale", "campo", "mobile", "centro"],
    "paese": ["Kenya", "Ciad", "Libano", "Nepal"],
    "regione": ["Nord", "Sud", "Est", "Ovest", "Centro"],
    "esito": ["dimesso", "ricoverato", "inviato", "deceduto", "in_corso"],
    "codice_icd10": ["J06", "A09", "I10", "E11", "B54"],
    "farmaco": ["paracetamolo", "amoxicillina", "metformina", "ORS"],
    "vaccino": ["morbillo", "polio", "BCG"],
    "analita": ["Hb", "glucosio", "creatinina"],
    "settore": ["salute", "acqua", "nutrizione"],
    "donatore": ["D1", "D2", "D3"],
    "stato": ["attivo", "chiuso", "sospeso"],
    "strumento": ["survey", "focus_group", "checklist"],
    "qualita": ["alta", "media", "bassa"],
    "articolo": ["kit", "coperte", "tende", "riso"],
    "ruolo": ["medico", "infermiere", "logista"],
    "gravita": ["lieve", "moderata", "grave"],
    "classe": ["analgesico", "antibiotico", "altro"],
    "unita": ["%", "g/dl", "n"],
    "direzione": ["su", "giu"],
    "sesso": ["F", "M"],
    "descrizione": ["respiratoria", "diarrea", "ipertensione", "diabete"],
}


def _roll(column: str, sides: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col("id"), F.lit(column), F.lit(seed)), F.lit(sides))


def _column(table: str, name: str, kind: str, size: int, seed: int) -> Column:
    roll = lambda n: _roll(f"{table}.{name}", n, seed)
    missing = F.pmod(F.xxhash64(F.col("id"), F.lit(f"{table}.{name}?"), F.lit(seed)), F.lit(100))
    parent = next((p for t, c, p in REFERENCES if (t, c) == (table, name)), None)
    if name == "id":
        return F.col("id")
    if parent:  # the last tenth of parents has no children
        return roll(max(1, ROWS[parent] * size * 9 // 10)) + 1
    if name in ("codice", "nome", "operatore", "responsabile"):
        number = roll(60) + 1 if name in ("operatore", "responsabile") else F.col("id")
        width = 6 if table == "pazienti" else 3
        return F.concat(F.lit({"pazienti": "PZ-", "visite": "OP-"}.get(table, f"{table[:3].upper()}-")), F.lpad(number.cast("string"), width, "0"))
    if name.startswith("data"):
        first, span = ("1940-01-01", 30_000) if name == "data_nascita" else ("2022-01-01", 1000)
        day = F.date_format(F.date_add(F.lit(first).cast("date"), roll(span).cast("int")), "yyyy-MM-dd")
        return F.when(missing >= 55, day) if name == "data_fine" else day
    if name in _CHOICES:
        return F.element_at(F.array(*map(F.lit, _CHOICES[name])), (roll(len(_CHOICES[name])) + 1).cast("int"))
    value = {"int": (roll(100) < 62).cast("int"), "long": roll(400) + 1, "double": (roll(40_000) / 100).cast("double")}[kind]
    return F.when(missing >= 6, value) if name in ("valore", "letti", "durata_min") else value


def table(spark: SparkSession, name: str, size: int = 1, seed: int = 42) -> DataFrame:
    """A practice table with ROWS[name] * size rows (indicators stay 14)."""
    rows = ROWS[name] * (1 if name == "indicatori" else size)
    fields = [f.split() for f in SCHEMA[name].split(", ")]
    return spark.range(1, rows + 1).select(*(_column(name, c, k, size, seed).cast("bigint" if k == "long" else k).alias(c) for c, k in fields))


def views(spark: SparkSession, size: int = 1, seed: int = 42) -> None:
    """All practice tables as temporary views."""
    for name in SCHEMA:
        table(spark, name, size, seed).createOrReplaceTempView(name)
