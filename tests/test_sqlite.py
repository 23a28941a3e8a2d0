"""Queries in SQLite's dialect: SQLite itself is the oracle, on generated practice tables."""

import sqlite3

import pytest

from sparkloom.functions import sqlite
from sparkloom.operators import compare
from sparkloom.sources import practice


@pytest.fixture(scope="module")
def both(spark):
    own = spark.newSession()
    con = sqlite3.connect(":memory:")
    for name in practice.SCHEMA:
        df = practice.table(own, name)
        df.createOrReplaceTempView(name)
        con.execute(f"CREATE TABLE {name} ({', '.join(df.columns)})")
        con.executemany(f"INSERT INTO {name} VALUES ({','.join('?' * len(df.columns))})", [tuple(r) for r in df.collect()])
    return own, con


QUERIES = {
    "filter": "SELECT codice, data_nascita FROM pazienti WHERE sesso = 'F' AND data_nascita >= '1990-01-01' AND regione IN ('Nord', 'Sud')",
    "like": "SELECT count(*) FROM strutture WHERE nome LIKE 'str-0%' AND tipo NOT LIKE 'MOB%'",
    "month": "SELECT strftime('%Y/%m', v.data) AS m, v.vaccino, sum(v.dose_num) AS dosi FROM vaccinazioni v GROUP BY m, v.vaccino HAVING sum(v.dose_num) > 300",
    "weekday": "SELECT strftime('%w', data), strftime('%W', data), count(*) FROM visite GROUP BY 1, 2",
    "quarter": "SELECT strumento, (CAST(strftime('%m', data) AS INTEGER) - 1) / 3 + 1 AS q, sum(intervistati) AS n FROM valutazioni WHERE completata = 1 GROUP BY strumento, q",
    "age": "SELECT id, CAST(julianday(data_fine) - julianday(data_inizio) AS INTEGER) AS giorni, CAST(strftime('%Y', data_inizio) AS INTEGER) AS anno FROM personale WHERE data_fine > data_inizio",
    "share": "SELECT tipo, 100.0 * count(*) / (SELECT count(*) FROM visite) AS pct FROM visite GROUP BY tipo",
    "left": "SELECT g.nome, g.donatore, count(q.id) AS persone, count(DISTINCT q.ruolo) AS ruoli FROM progetti g LEFT JOIN personale q ON q.progetto_id = g.id AND q.nazionale = 0 GROUP BY g.nome, g.donatore",
    "anti": "SELECT s.nome FROM siti s WHERE NOT EXISTS (SELECT 1 FROM distribuzioni d JOIN siti x ON x.id = d.sito_id WHERE d.sito_id = s.id)",
    "correlated": "SELECT id, (SELECT max(data) FROM visite v WHERE v.paziente_id = p.id) FROM pazienti p",
    "having": "SELECT paziente_id, count(*) AS n FROM visite GROUP BY paziente_id HAVING count(*) >= 6",
    "nulls": "SELECT count(*), count(valore), ifnull(avg(valore), 0) FROM misurazioni",
    "anomaly": "SELECT id, 100.0 * beneficiari / nullif(quantita, 0) FROM distribuzioni WHERE beneficiari > quantita",
    "concat": "SELECT visita_id, group_concat(DISTINCT codice_icd10) FROM diagnosi WHERE codice_icd10 IN ('J06', 'I10') GROUP BY visita_id HAVING count(DISTINCT codice_icd10) = 1",
    "dates": "SELECT id, date(data, '+7 days'), date(data, 'start of month'), date(data, 'start of month', '+1 month', '-1 day') FROM visite",
    "span": "SELECT p.id, date(v.data, '+' || p.giorni || ' days') FROM prescrizioni p JOIN visite v ON v.id = p.visita_id",
    "months": "WITH RECURSIVE m(d) AS (SELECT date('2023-01-01') UNION ALL SELECT date(d, '+1 month') FROM m WHERE d < '2023-12-01') SELECT m.d, count(v.id) FROM m LEFT JOIN visite v ON strftime('%Y-%m', v.data) = strftime('%Y-%m', m.d) GROUP BY m.d",
    "windows": "SELECT id, row_number() OVER w, rank() OVER w, lag(data) OVER w, sum(durata_min) OVER (PARTITION BY paziente_id ORDER BY data, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) FROM visite WINDOW w AS (PARTITION BY paziente_id ORDER BY data, id)",
    "filtered": "SELECT DISTINCT regione, count(*) FILTER (WHERE sesso = 'F') OVER (PARTITION BY regione) FROM pazienti",
    "sets": "SELECT paziente_id FROM vaccinazioni INTERSECT SELECT paziente_id FROM visite EXCEPT SELECT id FROM pazienti WHERE sfollato = 1",
    "full": "SELECT coalesce(a.r, b.r), a.n, b.n FROM (SELECT regione AS r, count(*) AS n FROM siti GROUP BY 1) a FULL JOIN (SELECT regione AS r, count(*) AS n FROM strutture WHERE attiva = 1 GROUP BY 1) b ON a.r = b.r",
    "json": "SELECT json_extract('{\"a\": {\"b\": \"x\"}}', '$.a.b'), json_object('n', id) FROM indicatori",
    "case": "SELECT progetto_id, sum(CASE WHEN nazionale = 1 THEN costo_mensile_eur ELSE 0 END), min(CASE WHEN ruolo = 'medico' THEN data_inizio END) FROM personale GROUP BY 1",
    "pareto": "WITH c AS (SELECT articolo, sum(quantita) AS q FROM distribuzioni GROUP BY 1) SELECT articolo, 100.0 * sum(q) OVER (ORDER BY q DESC, articolo) / sum(q) OVER () FROM c",
    "text": "SELECT 'it is 1.5 LIKE date(x)' AS t, upper(substr(nome, 1, 3)) || '-' || CAST(substr(nome, 5) AS INTEGER) FROM siti",
    # filters and projections
    "between": "SELECT id, quantita * costo_unitario_eur AS valore FROM distribuzioni WHERE quantita * costo_unitario_eur BETWEEN 1000 AND 9000 AND articolo <> 'riso'",
    "two_columns": "SELECT id, beneficiari - quantita AS eccesso FROM distribuzioni WHERE beneficiari > quantita * 2",
    "is_null": "SELECT count(*) FROM progetti WHERE data_fine IS NULL AND stato IN ('attivo', 'sospeso')",
    "not_null": "SELECT paese, count(*) FROM strutture WHERE letti IS NOT NULL AND attiva = 1 GROUP BY paese",
    "simple_case": "SELECT stato, CASE stato WHEN 'attivo' THEN 1 WHEN 'chiuso' THEN 2 ELSE 3 END AS ordine, count(*) FROM progetti GROUP BY 1, 2",
    "searched_case": "SELECT CASE WHEN letti IS NULL THEN '?' WHEN letti < 100 THEN 'piccola' WHEN letti < 250 THEN 'media' ELSE 'grande' END AS taglia, count(*) AS n FROM strutture GROUP BY taglia",
    "distinct_pairs": "SELECT DISTINCT regione, accessibile FROM siti",
    "top": "SELECT id, popolazione_stimata FROM siti ORDER BY popolazione_stimata DESC, id LIMIT 7",
    "page": "SELECT id FROM esami_lab ORDER BY visita_id, id LIMIT 5 OFFSET 20",
    "predicate_sum": "SELECT sum(fuori_range = 1) AS fuori, sum(valore > 200) AS alti FROM esami_lab WHERE valore IS NOT NULL",
    "not_in": "SELECT count(*) FROM personale WHERE ruolo NOT IN ('medico', 'logista') AND costo_mensile_eur >= 150.5",
    # joins
    "three_tables": "SELECT t.codice, x.farmaco, x.dose_mg FROM prescrizioni x JOIN visite v ON v.id = x.visita_id JOIN pazienti t ON t.id = v.paziente_id WHERE x.giorni > 380 AND v.tipo = 'campo'",
    "four_tables": "SELECT g.settore, i.codice, count(*) AS n, round(avg(m.valore), 3) AS media FROM misurazioni m JOIN indicatori i ON i.id = m.indicatore_id JOIN valutazioni w ON w.id = m.valutazione_id JOIN siti z ON z.id = w.sito_id JOIN progetti g ON g.id = z.progetto_id GROUP BY g.settore, i.codice",
    "left_null": "SELECT z.nome FROM siti z LEFT JOIN valutazioni w ON w.sito_id = z.id WHERE w.id IS NULL",
    "not_exists": "SELECT count(*) FROM pazienti t WHERE NOT EXISTS (SELECT 1 FROM vaccinazioni v WHERE v.paziente_id = t.id AND v.vaccino = 'polio')",
    "exists": "SELECT nome FROM progetti g WHERE EXISTS (SELECT 1 FROM personale q WHERE q.progetto_id = g.id AND q.ruolo = 'medico' AND q.nazionale = 1)",
    "exists_key": "SELECT CASE WHEN EXISTS (SELECT 1 FROM distribuzioni d WHERE d.sito_id = z.id) THEN 'servito' ELSE 'no' END AS gruppo, count(*) AS n, sum(z.popolazione_stimata) AS p FROM siti z GROUP BY gruppo",
    "self_pairs": "SELECT a.id, b.id FROM strutture a JOIN strutture b ON a.paese = b.paese AND a.regione = b.regione AND a.tipo = b.tipo AND a.id < b.id",
    "self_dates": "SELECT a.struttura_id, a.vaccino, count(*) FROM vaccinazioni a JOIN vaccinazioni b ON a.struttura_id = b.struttura_id AND a.vaccino = b.vaccino AND b.data > a.data AND julianday(b.data) - julianday(a.data) <= 700 GROUP BY 1, 2",
    "cross": "SELECT g.settore, r.ruolo, count(q.id) AS n FROM (SELECT DISTINCT settore FROM progetti) g CROSS JOIN (SELECT DISTINCT ruolo FROM personale) r LEFT JOIN (SELECT q.id, q.ruolo, g.settore FROM personale q JOIN progetti g ON g.id = q.progetto_id) q ON q.settore = g.settore AND q.ruolo = r.ruolo GROUP BY 1, 2",
    "bands": "SELECT f.nome, count(e.id) FROM (SELECT 'basso' AS nome, 0 AS da, 100 AS a UNION ALL SELECT 'medio', 100, 250 UNION ALL SELECT 'alto', 250, 401) f LEFT JOIN esami_lab e ON e.valore >= f.da AND e.valore < f.a AND e.analita = 'Hb' GROUP BY f.nome",
    # aggregates
    "distinct_count": "SELECT struttura_id, count(DISTINCT paziente_id) AS pazienti, count(*) AS visite FROM visite GROUP BY struttura_id",
    "two_levels": "SELECT n, count(*) AS quanti FROM (SELECT sito_id, count(*) AS n FROM valutazioni GROUP BY sito_id) GROUP BY n",
    "conditional": "SELECT sito_id, sum(CASE WHEN articolo = 'kit' THEN quantita ELSE 0 END) AS kit, sum(CASE WHEN articolo = 'tende' THEN quantita ELSE 0 END) AS tende, max(CASE WHEN beneficiari > 300 THEN data END) AS ultima FROM distribuzioni GROUP BY sito_id",
    "pivot": "SELECT tipo, sum(esito = 'dimesso') AS dimessi, sum(esito = 'ricoverato') AS ricoverati, sum(esito NOT IN ('dimesso', 'ricoverato')) AS altri FROM visite GROUP BY tipo",
    "variance": "SELECT analita, avg(valore * valore) - avg(valore) * avg(valore) AS varianza FROM esami_lab GROUP BY analita",
    "outliers": "SELECT e.id FROM esami_lab e JOIN (SELECT analita, avg(valore) AS m, avg(valore * valore) - avg(valore) * avg(valore) AS v FROM esami_lab GROUP BY analita) s ON s.analita = e.analita WHERE (e.valore - s.m) * (e.valore - s.m) > 2.7 * s.v",
    "weights": "SELECT v.tipo, sum(1.0 / d.n) AS peso FROM visite v JOIN (SELECT visita_id, count(*) AS n FROM diagnosi GROUP BY visita_id) d ON d.visita_id = v.id GROUP BY v.tipo",
    "median": "SELECT farmaco, avg(giorni) FROM (SELECT farmaco, giorni, row_number() OVER (PARTITION BY farmaco ORDER BY giorni, id) AS k, count(*) OVER (PARTITION BY farmaco) AS n FROM prescrizioni) WHERE k IN ((n + 1) / 2, (n + 2) / 2) GROUP BY farmaco",
    "listed": "SELECT progetto_id, group_concat(DISTINCT ruolo) AS ruoli FROM personale WHERE nazionale = 0 GROUP BY progetto_id HAVING count(DISTINCT ruolo) = 1",
    "global_share": "SELECT articolo, round(100.0 * sum(quantita) / (SELECT sum(quantita) FROM distribuzioni), 2) AS pct FROM distribuzioni GROUP BY articolo",
    # windows
    "ranks": "SELECT id, rank() OVER (PARTITION BY settore ORDER BY stato) AS r, dense_rank() OVER (PARTITION BY settore ORDER BY stato) AS d, percent_rank() OVER (PARTITION BY settore ORDER BY budget_eur, id) AS p FROM progetti",
    "tiles": "SELECT quarto, count(*), min(costo_mensile_eur) FROM (SELECT costo_mensile_eur, ntile(4) OVER (ORDER BY costo_mensile_eur, id) AS quarto FROM personale) GROUP BY quarto",
    "latest": "SELECT paziente_id, vaccino, data FROM (SELECT *, row_number() OVER (PARTITION BY paziente_id ORDER BY data DESC, id DESC) AS k FROM vaccinazioni) WHERE k = 1",
    "second": "SELECT sito_id, data FROM (SELECT sito_id, data, row_number() OVER (PARTITION BY sito_id ORDER BY data, id) AS k FROM valutazioni) WHERE k = 2",
    "gaps": "SELECT sito_id, data, julianday(data) - julianday(lag(data) OVER (PARTITION BY sito_id ORDER BY data, id)) AS giorni, lead(data, 2) OVER (PARTITION BY sito_id ORDER BY data, id) AS poi FROM distribuzioni",
    "ends": "SELECT id, first_value(quantita) OVER w AS prima, last_value(quantita) OVER w AS ultima FROM distribuzioni WINDOW w AS (PARTITION BY sito_id ORDER BY data, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "moving": "SELECT id, avg(beneficiari) OVER (PARTITION BY sito_id ORDER BY data, id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS media3 FROM distribuzioni",
    "deviation": "SELECT id, valore - avg(valore) OVER (PARTITION BY analita, unita) AS scarto FROM esami_lab WHERE fuori_range = 1",
    "growth": "WITH m AS (SELECT strftime('%Y-%m', data) AS mese, count(*) AS n FROM visite GROUP BY 1) SELECT mese, n - lag(n) OVER (ORDER BY mese) AS delta, 100.0 * n / lag(n) OVER (ORDER BY mese) AS pct FROM m",
    "islands": "WITH d AS (SELECT sito_id, data FROM distribuzioni GROUP BY 1, 2), g AS (SELECT *, CASE WHEN julianday(data) - julianday(lag(data) OVER (PARTITION BY sito_id ORDER BY data)) <= 60 THEN 0 ELSE 1 END AS nuova FROM d), i AS (SELECT *, sum(nuova) OVER (PARTITION BY sito_id ORDER BY data) AS isola FROM g) SELECT sito_id, isola, min(data), max(data), count(*) FROM i GROUP BY 1, 2",
    "declines": "WITH x AS (SELECT sito_id, data, quantita AS q, lag(quantita) OVER w AS q1, lag(quantita, 2) OVER w AS q2 FROM distribuzioni WINDOW w AS (PARTITION BY sito_id ORDER BY data, id)) SELECT sito_id, data FROM x WHERE q < q1 AND q1 < q2",
    # sets, recursion, dates
    "union_counts": "SELECT 'siti' AS cosa, count(*) AS n FROM siti UNION ALL SELECT 'aperti', count(*) FROM siti WHERE accessibile = 1 UNION ALL SELECT 'progetti', count(*) FROM progetti",
    "except_ids": "SELECT id FROM siti EXCEPT SELECT sito_id FROM valutazioni WHERE completata = 1",
    "series": "WITH RECURSIVE n(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM n WHERE k < 30) SELECT k, k * k FROM n WHERE k NOT IN (SELECT dose_num FROM vaccinazioni)",
    "days_without": "WITH RECURSIVE g(d) AS (SELECT date('2022-03-01') UNION ALL SELECT date(d, '+1 day') FROM g WHERE d < '2022-03-31') SELECT d FROM g WHERE NOT EXISTS (SELECT 1 FROM distribuzioni x WHERE x.data = g.d)",
    "due": "SELECT id, date(data, '+28 days') AS scade, date(data, 'start of month', '+2 months', '-1 day') AS fine FROM vaccinazioni WHERE dose_num < 20",
    "label": "SELECT 'Q' || ((CAST(strftime('%m', data_inizio) AS INTEGER) + 2) / 3) || ' ' || strftime('%Y', data_inizio) AS q, count(*) FROM progetti GROUP BY q",
    # JSON, text, quality
    "json_pairs": "SELECT id, json_object('c', codice, 'd', disaggregabile) AS j FROM indicatori",
    "json_path": "SELECT json_extract(j, '$.a') FROM (SELECT json_object('a', nome) AS j FROM indicatori)",
    "substring": "SELECT substr(codice, 4, 3) AS parte, count(*) FROM pazienti GROUP BY parte HAVING count(*) > 5",
    "names": "SELECT trim('  ' || upper(ruolo) || ' ') || ': ' || lower(substr('ABC', 1, 2)) AS t, length(ruolo) FROM personale GROUP BY ruolo",
    "completeness": "SELECT 'valore' AS campo, 100.0 * count(valore) / count(*) AS pct FROM misurazioni UNION ALL SELECT 'letti', 100.0 * count(letti) / count(*) FROM strutture",
    "impossible": "SELECT count(*) FROM personale WHERE data_fine < data_inizio",
    "orphans": "SELECT count(*) FROM esami_lab e LEFT JOIN visite v ON v.id = e.visita_id WHERE v.id IS NULL",
    "safe_ratio": "SELECT id, round(1.0 * beneficiari / nullif(quantita - 1, 0), 3) AS r, coalesce(nullif(articolo, 'riso'), 'cibo') FROM distribuzioni",
    "catalogue": "SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name",
}


def cell(v):
    if isinstance(v, bool):
        return str(int(v))
    return f"{float(v):.6f}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else "∅" if v is None else str(v)


@pytest.mark.parametrize("name", QUERIES)
def test_dialect(both, name):
    """Rows as SQLite gives them, in its order where the statement asks for one; and the comparator says so."""
    own, con = both
    df = sqlite.query(own, QUERIES[name])
    rows = con.execute(QUERIES[name]).fetchall()
    got, expected = ([tuple(map(cell, r)) for r in x] for x in (df.collect(), rows))
    ordered = "LIMIT" in QUERIES[name]
    assert (got == expected if ordered else sorted(got) == sorted(expected)) and got


@pytest.mark.parametrize("name", ["filter", "top", "ranks", "pivot", "series", "names"])
def test_judged_against_sqlite(both, name):
    """SQLite's rows as the expected frame, the answer's as the other: the verdict ladder agrees with itself."""
    own, con = both
    df = sqlite.query(own, QUERIES[name])
    expected = own.createDataFrame([tuple(r) for r in con.execute(QUERIES[name]).fetchall()], df.schema)
    assert compare.judged(expected, df, name == "top") in (compare.Verdict.SAME, compare.Verdict.SAME_BUT_ORDER)
    assert compare.judged(expected, df.limit(2)) == compare.Verdict.ROWS


def test_corpus_is_valid(both):
    own, _ = both
    some = {n: QUERIES[n] for n in ("filter", "top", "union_counts", "series")} | {"empty": "SELECT id FROM siti WHERE id < 0", "broken": "SELECT x FROM siti"}
    found = {r.name: r.problem for r in compare.validated(own, some, lambda sql: sqlite.query(own, sql)).collect()}
    assert found.keys() == {"empty", "broken"} and found["empty"] == "no rows" and found["broken"].startswith("does not run")


def test_pragmas(both):
    own, con = both
    for name in practice.SCHEMA:
        assert [(r.cid, r.name) for r in sqlite.query(own, f"PRAGMA table_info({name})").collect()] == [x[:2] for x in con.execute(f"PRAGMA table_info({name})").fetchall()]
    con.execute("CREATE TABLE visite_rif (id, paziente_id REFERENCES pazienti(id), struttura_id REFERENCES strutture(id))")
    expected = [x[:5] for x in con.execute("PRAGMA foreign_key_list(visite_rif)").fetchall()]
    con.execute("DROP TABLE visite_rif")
    assert [tuple(r)[:5] for r in sqlite.query(own, "PRAGMA foreign_key_list('visite');", practice.REFERENCES).collect()] == expected
    assert sqlite.query(own, "pragma index_list(visite)").isEmpty()


@pytest.mark.parametrize(
    "sql, step",
    [
        ("SELECT id FROM visite WHERE data >= '2023-01-01' AND data < '2023-02-01'", "Filter"),
        ("SELECT id FROM visite WHERE strftime('%Y', data) = '2023'", "Filter"),
        ("SELECT p.codice, count(*) FROM visite v JOIN pazienti p ON p.id = v.paziente_id GROUP BY p.codice", "Join"),
        ("SELECT s.nome, count(v.id) FROM strutture s LEFT JOIN visite v ON v.struttura_id = s.id GROUP BY s.nome", "Outer"),
        ("SELECT id FROM visite WHERE durata_min > (SELECT avg(durata_min) FROM visite)", "ubquery"),
        ("SELECT paziente_id, count(DISTINCT tipo) FROM visite GROUP BY paziente_id", "Aggregate"),
        ("SELECT id FROM visite ORDER BY data, id LIMIT 3", "TakeOrderedAndProject"),
        ("SELECT id, rank() OVER (PARTITION BY tipo ORDER BY data) FROM visite", "Window"),
    ],
)
def test_explain(both, sql, step):
    plan = sqlite.query(both[0], f"EXPLAIN QUERY PLAN {sql}").collect()
    assert [r.id for r in plan] == list(range(len(plan))) and any(step in r.detail for r in plan)


def test_practice_tables_keep_their_anomalies(both):
    own, _ = both
    for child, field, parent in practice.REFERENCES:
        assert own.sql(f"SELECT 1 FROM {child} c LEFT ANTI JOIN {parent} p ON p.id = c.{field}").isEmpty()
    assert own.sql("SELECT count(*) FROM misurazioni WHERE valore IS NULL").first()[0] > 0
    assert own.sql("SELECT count(*) FROM siti s LEFT ANTI JOIN distribuzioni d ON d.sito_id = s.id").first()[0] > 0
