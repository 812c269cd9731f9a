"""Parts of a written address: streets, doors, kilometres, blocks, lots and localities.

An address is cut before every word that opens something: a street, a road, a crossing, a locality, a kilometre, a block, a
lot. Each piece is then read by itself with patterns, all inside the JVM. What follows a landmark word is only a reference,
so streets, doors, localities and kilometres are read before the first of them; blocks and lots are read everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewarden.functions.text import let, plain_upper

# --- fixed values: vocabulary of the addresses ---------------------------------------------------
STREET_PREFIXES = (
    "AV", "AVENIDA", "AVDA", "JR", "JIRON", "CA", "CAL", "CALLE", "PSJE", "PASAJE", "PJE", "PROL", "PROLONGACION", "MALECON",
    "OVALO", "BLVD", "BOULEVARD", "VIA",
)
ROAD_PREFIXES = ("CARR", "CAR", "CARRET", "CARRETERA", "AUTOPISTA", "PAN", "PANAM", "PANAMERICANA")
LOCALITY_WORDS = (
    "URB", "URBANIZACION", "AAHH", "AH", "ASOC", "ASOCIACION", "COOP", "COOPERATIVA", "PJ", "PUEBLO", "PROGRAMA", "RES",
    "RESIDENCIAL", "CONJ", "CONJUNTO", "CH", "HABILITACION", "HABILIT", "LOTIZACION", "FUNDO", "FDO", "PREDIO", "PARCELA",
    "PARC", "PARCELACION", "SECTOR", "ZONA", "GRUPO", "ETAPA", "COMUNIDAD", "CP", "ANEXO", "BARRIO", "APV", "UNIDAD", "UNID",
    "SECCION", "CASERIO",
)
CROSSING_WORDS = ("ESQ", "ESQUINA", "CON", "CRUCE", "INTERSECCION", "INTERSEC", "INTER", "Y", "ENTRE", "ANTES", "EX")
LANDMARK_WORDS = ("ALT", "ALTURA", "FRENTE", "REF", "REFERENCIA", "PARADERO", "COSTADO", "ESPALDA", "CERCA")
NUMBERED_INSIDE = (
    "INT", "INTERIOR", "PISO", "DPTO", "DEPARTAMENTO", "OF", "OFICINA", "TIENDA", "LOCAL", "PUESTO", "CDRA", "CUADRA", "UC",
    "SUB",
)
BLOCK_WORDS = ("MZ", "MZA", "MANZANA")
LOT_WORDS = ("LT", "LTS", "LTE", "LOTE", "LOTES", "LOT", "SUBLOTE")
MONTHS = (
    "ENERO", "FEBRERO", "MARZO", "ABRIL", "MAYO", "JUNIO", "JULIO", "AGOSTO", "SETIEMBRE", "SEPTIEMBRE", "OCTUBRE",
    "NOVIEMBRE", "DICIEMBRE",
)
EMPTY_WORDS = ("DE", "DEL", "LA", "LAS", "LOS", "EL", "AL", "EN", "SIN", "NOMBRE")
GENERIC_STREET_WORDS = ("NORTE", "SUR", "ESTE", "OESTE", "CENTRAL", "ANTIGUA", "NUEVA", "NUEVO", "PRINCIPAL")
GENERIC_LOCALITY_WORDS = (
    "JOVEN", "PROYECTO", "ESPECIAL", "VIVIENDA", "VIVIENDAS", "POBLADO", "ASENTAMIENTO", "HUMANO", "AGRUPACION", "FAMILIAR",
    "PRODUCTORES", "AGROPECUARIA", "AGRICOLA", "INDUSTRIAL", "INDUSTRIALES", "PECUARIOS", "INMOBILIARIA", "RUSTICO", "SEMI",
    "MIXTA", "NUEVO", "NUEVA", "VILLA", "RESIDENCIAL", "CAMPESINA", "CAMPESINO", "UNIDAD", "VECINAL", "SUBLOTE", "PARCELA",
    "LOTIZACION", "HABILITACION", "URBANA", "COMERCIAL", "TALLER", "CASA",
)
ROAD = "CARRETERA"

PARTS = ("streets", "generics", "locality", "doors", "km", "blocks", "lots")
# Words that open a piece, and so end the one before.
_NAMING = (*STREET_PREFIXES, *ROAD_PREFIXES, *CROSSING_WORDS)
_NUMBER = r"\d+(?:\.\d+)?(?:[A-Z]{1,4})?"
_OPENING = (*_NAMING, *LOCALITY_WORDS, *BLOCK_WORDS, *LOT_WORDS, "SN")


def _any(words: tuple[str, ...]) -> str:
    """A pattern for any of the words, the longest first. Words share their beginnings, so most texts fail at one letter."""

    def told(rests: set[str]) -> str:
        firsts = sorted({r[0] for r in rests if r})
        branches = [first + told({r[1:] for r in rests if r[:1] == first}) for first in firsts]
        found = "" if not branches else branches[0] if len(branches) == 1 and "" not in rests else "(?:" + "|".join(branches) + ")"
        return f"{found}?" if found and "" in rests else found

    return "(?=[" + "".join(sorted({w[0] for w in words})) + "])(?:" + told(set(words)) + ")"


def spelled(col: Column) -> Column:
    """Words of an address, upper case and without accents, separated by single blanks; numbers keep their decimals."""
    text = plain_upper(col)
    text = F.regexp_replace(text, r"([A-Z])(?<![A-Z0-9][A-Z])\s*[./]\s*(?=[A-Z](?![A-Z0-9]))", "$1")  # A.H., S/N
    text = F.regexp_replace(text, r"(?=A)\bAA\W*HH\b", "AAHH")
    text = F.regexp_replace(text, r"(?=N)\b(?:(?:NUMERO|NRO|NO|N)\b\W*(?=\d)|N\s*[°º])", " NRO ")
    text = F.regexp_replace(text, r"KM(?<=[A-Z]{3}KM)(?=[\s.\d])", " KM ")
    text = F.regexp_replace(text, rf"(?=[KL])\b({_any(('KM', *LOT_WORDS))})\.?(?=\d)", "$1 ")
    text = F.regexp_replace(text, r"(?<!\d)\.|\.(?!\d)|[^A-Z0-9. ]", " ")
    return F.trim(F.regexp_replace(text, " {2,}", " "))


def _unpadded(numbers: Column) -> Column:
    return F.transform(numbers, lambda n: F.regexp_replace(n, r"^0+(?=\d)", ""))


def _sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _until(words: Column, stop) -> Column:
    """The words before the first that passes `stop`; all if none does."""
    at = F.array_position(F.transform(words, stop), F.lit(True))
    return let(at, lambda i: F.when(i > 0, F.slice(words, 1, (i - 1).cast("int"))).otherwise(words))


def _from(words: Column, start) -> Column:
    """The words from the first that passes `start`; none if none does."""
    at = F.array_position(F.transform(words, start), F.lit(True))
    return let(at, lambda i: F.when(i > 0, F.slice(words, i.cast("int"), F.size(words))).otherwise(F.filter(words, lambda w: F.lit(False))))


def _without_first(words: Column, when: Column) -> Column:
    return F.when(when, F.slice(words, 2, F.size(words))).otherwise(words)


def _named(piece: Column) -> Column:
    """Name words, generic words and doors of one piece that names a street.

    The name ends at the first number or number sign; the numbers from there on, without a gap, are doors. A number that
    stands where the name should is part of it, as in CALLE 3, unless a number sign says otherwise.
    """
    number = lambda w: w.rlike(rf"^{_NUMBER}$")
    opens = F.coalesce(F.substring_index(piece, " ", 1).isin(*_NAMING), F.lit(False))

    def read(body: Column) -> Column:
        leads = F.coalesce(number(F.get(body, F.lit(0))), F.lit(False))
        return let(_without_first(body, leads), lambda rest: parts(rest, leads))

    def parts(rest: Column, leads: Column) -> Column:
        words = F.filter(_until(rest, lambda w: number(w) | (w == "NRO")), lambda w: (F.length(w) >= 3) & ~w.isin(*EMPTY_WORDS))
        tail = _from(rest, lambda w: number(w) | (w == "NRO"))
        run = let(tail, lambda t: _until(t, lambda w: ~(number(w) | (w == "NRO"))))
        doors = F.transform(F.filter(run, number), lambda w: F.regexp_extract(w, r"^\d+", 0))
        told = leads | (F.size(words) > 0) | F.coalesce(F.get(tail, F.lit(0)) == "NRO", F.lit(False))
        return F.struct(
            F.filter(words, lambda w: ~w.isin(*GENERIC_STREET_WORDS)).alias("names"),
            F.filter(words, lambda w: w.isin(*GENERIC_STREET_WORDS)).alias("generics"),
            F.filter(doors, lambda w: told).alias("doors"),
        )

    return let(_without_first(_words(piece), opens), read)


def _parts(text: Column) -> Column:
    head = F.regexp_replace(text, rf"(?:^| ){_any(LANDMARK_WORDS)}(?: .*|$)", "")
    # Dates are names, numbers inside a building or of a stage are no doors.
    head = F.regexp_replace(head, rf"(?=\d)\b0*(\d+) (?:DE )?({'|'.join(MONTHS)})\b", "$1_$2")
    head = F.regexp_replace(head, rf"(?={_any(NUMBERED_INSIDE)})\b{_any(NUMBERED_INSIDE)}\b(?: \d\S*)?", " / ")
    head = F.regexp_replace(head, r"(?=\d)\b\d+\S* (?=ETAPA\b)", "")
    cut = lambda h: F.split(F.trim(F.regexp_replace(h, " {2,}", " ")), rf" (?={_any((*_OPENING, 'KM'))}(?: |$))")
    return let(head, lambda h: let(cut(h), lambda pieces: _told(text, h, pieces)))


def _told(text: Column, head: Column, pieces: Column) -> Column:
    """What the pieces of a head say, and the blocks and lots of the whole text; all three are read once and named."""
    opens = lambda words: lambda p: F.substring_index(p, " ", 1).isin(*words)
    other = tuple(w for w in (*_OPENING, "KM") if w not in _NAMING)
    naming = F.transform(F.filter(pieces, lambda p: ~opens(other)(p)), _named)
    settled = F.flatten(F.transform(F.filter(pieces, opens(LOCALITY_WORDS)), _words))
    generic = ("NRO", *GENERIC_LOCALITY_WORDS, *LOCALITY_WORDS, *GENERIC_STREET_WORDS, *EMPTY_WORDS)
    # After a kilometre, a block or the mark for no number, only a number sign tells a door; numbers right after it are doors too.
    beside = F.filter(pieces, opens(("KM", "SN", *BLOCK_WORDS)))
    signed = F.flatten(F.transform(beside, lambda p: F.regexp_extract_all(p, F.lit(rf"\bNRO ((?:{_NUMBER}(?: |$))+)"), F.lit(1))))
    numbered = F.transform(F.flatten(F.transform(signed, _words)), lambda w: F.regexp_extract(w, r"^\d+", 0))
    km = F.regexp_extract_all(head, F.lit(r"\bKM (\d+(?:\.\d+)?)\b"), F.lit(1))
    blocks = F.regexp_extract_all(
        text, F.lit(rf"(?=M)\b{_any(BLOCK_WORDS)} (?!{_any((*BLOCK_WORDS, *LOT_WORDS, *LOCALITY_WORDS))}\b)([A-Z]{{1,2}} \d{{1,2}}(?= {_any(LOT_WORDS)}\b|$)|[A-Z0-9]{{1,4}}\b)"), F.lit(1)
    )
    # Lots that Y joins stay in one piece; a piece begins with the word for lot and lists them.
    listed = F.regexp_replace(F.regexp_replace(text, r"(?=\d)\b\d+\S* (?=ETAPA\b)", "/ "), r"(?<= \d{1,3}[A-Z]?) Y (?=\d{1,3}[A-Z]?(?: |$))", " ")
    lot_pieces = F.filter(F.split(listed, rf" (?={_any(_OPENING)}(?: |$))"), opens(LOT_WORDS))
    lots = F.transform(lot_pieces, lambda p: let(F.slice(_words(p), 2, F.size(_words(p))), lambda found: _until(found, lambda w: ~w.rlike(r"^(?:NRO|SUB|\d{1,3}[A-Z]?|[A-Z])$"))))
    return let(
        naming,
        lambda streets: F.struct(
            _sorted(F.flatten(F.transform(streets, lambda s: F.transform(s["names"], lambda w: F.replace(w, F.lit("_"), F.lit("")))))).alias("streets"),
            _sorted(
                F.concat(
                    F.flatten(F.transform(streets, lambda s: s["generics"])),
                    F.when(F.exists(pieces, opens(ROAD_PREFIXES)), F.array(F.lit(ROAD))).otherwise(F.array().cast("array<string>")),
                )
            ).alias("generics"),
            _sorted(F.filter(settled, lambda w: (F.length(w) >= 3) & ~w.isin(*generic) & ~w.rlike(r"^\d|[_/.]"))).alias("locality"),
            _sorted(F.filter(_unpadded(F.concat(F.flatten(F.transform(streets, lambda s: s["doors"])), numbered)), lambda n: F.length(n).between(2, 5))).alias("doors"),
            _sorted(F.transform(_unpadded(km), lambda n: F.regexp_replace(n, r"\.0+$|(\.\d*?)0+$", "$1"))).alias("km"),
            _sorted(F.transform(blocks, lambda b: F.regexp_replace(F.replace(b, F.lit(" "), F.lit("")), r"^([A-Z]*)0+(?=\d)", "$1"))).alias("blocks"),
            _sorted(_unpadded(F.filter(F.flatten(lots), lambda w: ~w.isin("NRO", "SUB")))).alias("lots"),
        ),
    )


def address_parts(col: Column) -> Column:
    """Parts of an address as a struct of sorted arrays."""
    return let(spelled(col), _parts)
