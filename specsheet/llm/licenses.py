"""License scan: ordered signature rules behind a keyword prefilter.

Hand-written rules know SPDX expressions (every id in them) and the wordings of licence texts themselves;
every licence further has rules for its web addresses, notices that grant it and its names.
A rule's regex runs only on texts that hold one of its keywords. Detections are taken in order of
priority, then length, then place; one whose interval lies inside an accepted detection of another
rule is suppressed. Base phrases are counted at every place where their words stand one after the
other, and their labels always stay. Rows are independent: no shuffle.

Cases: a null text is empty; a text without words or phrases has no places, empty labels and score
0; rows are judged each, in any number; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import text_bytes, word_bounds

#: Bytes between words once A-Z are lower: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` is a word.
NO_WORD = np.zeros(256, dtype=bool)
NO_WORD[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_EDGE = rb"[0-9a-z\x80-\xff]"

#: Base phrases and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

# label, SPDX id pattern, name patterns (words; "~" stands for what separates words), addresses
_LICENCES = [
    ("gpl-2.0", r"gpl-2\.0(?:-only|-or-later|\+)?", ["gnu~general~public~license~(?:version~|v)2", "gpl~?v?2"], ["gnu.org/licenses/old-licenses/gpl-2.0", "gnu.org/licenses/gpl-2.0"]),
    ("gpl-3.0", r"gpl-3\.0(?:-only|-or-later|\+)?", ["gnu~general~public~license~(?:version~|v)3", "gpl~?v?3"], ["gnu.org/licenses/gpl-3.0"]),
    ("gpl", r"gpl", ["gnu~general~public~licen[cs]e", "gnu~gpl"], ["gnu.org/licenses/gpl", "gnu.org/copyleft/gpl"]),
    ("lgpl-2.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", ["gnu~lesser~general~public~license~(?:version~|v)2", "lgpl~?v?2"], ["gnu.org/licenses/lgpl-2.1", "gnu.org/licenses/old-licenses/lgpl-2.1"]),
    ("lgpl-3.0", r"lgpl-3\.0(?:-only|-or-later|\+)?", ["gnu~lesser~general~public~license~(?:version~|v)3", "lgpl~?v?3"], ["gnu.org/licenses/lgpl-3.0"]),
    ("lgpl", r"lgpl", ["gnu~(?:lesser|library)~general~public~licen[cs]e", "gnu~lgpl"], ["gnu.org/licenses/lgpl"]),
    ("agpl-3.0", r"agpl-3\.0(?:-only|-or-later|\+)?", ["gnu~affero~general~public~licen[cs]e", "gnu~agpl", "agpl~?v?3"], ["gnu.org/licenses/agpl"]),
    ("gfdl", r"gfdl-1\.[123]\S*", ["gnu~free~documentation~licen[cs]e"], ["gnu.org/licenses/fdl", "gnu.org/copyleft/fdl"]),
    ("apache-2.0", r"apache-2\.0", ["apache~licen[cs]e~version~2", "apache~licen[cs]e~2", "apache~2~0"], ["apache.org/licenses/license-2.0"]),
    ("apache-1.1", r"apache-1\.1", ["apache~software~licen[cs]e~(?:version~)?1~1"], ["apache.org/licenses/license-1.1"]),
    ("apache", r"apache", ["apache~licen[cs]e", "apache~software~licen[cs]e"], ["apache.org/licenses"]),
    ("mit", r"mit", ["mit~licen[cs]e", "expat~licen[cs]e", "mit~style~licen[cs]e"], ["opensource.org/licenses/mit", "mit-license.org"]),
    ("mit-0", r"mit-0", ["mit~no~attribution"], ["opensource.org/licenses/mit-0"]),
    ("x11", r"x11", ["x11~licen[cs]e", "x~consortium~licen[cs]e"], []),
    ("bsd-2-clause", r"bsd-2-clause\S*", ["bsd~2~clause", "2~clause~bsd", "two~clause~bsd", "simplified~bsd~licen[cs]e", "freebsd~licen[cs]e"], ["opensource.org/licenses/bsd-2-clause"]),
    ("bsd-3-clause", r"bsd-3-clause\S*", ["bsd~3~clause", "3~clause~bsd", "three~clause~bsd", "new~bsd~licen[cs]e", "modified~bsd~licen[cs]e"], ["opensource.org/licenses/bsd-3-clause"]),
    ("bsd-4-clause", r"bsd-4-clause\S*", ["bsd~4~clause", "4~clause~bsd", "original~bsd~licen[cs]e"], []),
    ("bsd", r"bsd", ["bsd~licen[cs]e", "bsd~style~licen[cs]e"], ["opensource.org/licenses/bsd-license"]),
    ("isc", r"isc", ["isc~licen[cs]e"], ["opensource.org/licenses/isc", "isc.org/licenses"]),
    ("mpl-2.0", r"mpl-2\.0\S*", ["mozilla~public~licen[cs]e~(?:version~|v)?2", "mpl~?v?2"], ["mozilla.org/mpl/2.0"]),
    ("mpl-1.1", r"mpl-1\.1", ["mozilla~public~licen[cs]e~(?:version~|v)?1"], ["mozilla.org/mpl/mpl-1.1"]),
    ("mpl", r"mpl", ["mozilla~public~licen[cs]e"], ["mozilla.org/mpl"]),
    ("epl-2.0", r"epl-2\.0", ["eclipse~public~licen[cs]e~(?:version~|v)?2"], ["eclipse.org/legal/epl-2.0", "eclipse.org/legal/epl-v20"]),
    ("epl-1.0", r"epl-1\.0", ["eclipse~public~licen[cs]e"], ["eclipse.org/legal/epl-v10"]),
    ("cddl-1.0", r"cddl-1\.[01]", ["common~development~and~distribution~licen[cs]e"], ["opensource.org/licenses/cddl"]),
    ("cpl-1.0", r"cpl-1\.0", ["common~public~licen[cs]e"], ["opensource.org/licenses/cpl"]),
    ("eupl-1.2", r"eupl-1\.[12]", ["european~union~public~licen[cs]e"], ["joinup.ec.europa.eu/collection/eupl"]),
    ("artistic-2.0", r"artistic-[12]\.0\S*", ["artistic~licen[cs]e"], ["opensource.org/licenses/artistic-license"]),
    ("bsl-1.0", r"bsl-1\.0", ["boost~software~licen[cs]e"], ["boost.org/license_1_0"]),
    ("zlib", r"zlib\S*", ["zlib~licen[cs]e", "zlib~libpng~licen[cs]e"], ["opensource.org/licenses/zlib"]),
    ("unlicense", r"unlicense", ["the~unlicense"], ["unlicense.org"]),
    ("wtfpl", r"wtfpl", ["do~what~the~fuck~you~want~to~public~licen[cs]e", "wtfpl"], ["wtfpl.net"]),
    ("cc0-1.0", r"cc0-1\.0", ["cc0", "creative~commons~zero", "cc~zero"], ["creativecommons.org/publicdomain/zero"]),
    ("cc-by-sa", r"cc-by-sa-\d\.\d", ["cc~by~sa", "creative~commons~attribution~share~?alike"], ["creativecommons.org/licenses/by-sa"]),
    ("cc-by-nc-sa", r"cc-by-nc-sa-\d\.\d", ["cc~by~nc~sa", "creative~commons~attribution~non~?commercial~share~?alike"], ["creativecommons.org/licenses/by-nc-sa"]),
    ("cc-by-nc-nd", r"cc-by-nc-nd-\d\.\d", ["cc~by~nc~nd", "creative~commons~attribution~non~?commercial~no~?deriv(?:ative)?s"], ["creativecommons.org/licenses/by-nc-nd"]),
    ("cc-by-nc", r"cc-by-nc-\d\.\d", ["cc~by~nc", "creative~commons~attribution~non~?commercial"], ["creativecommons.org/licenses/by-nc"]),
    ("cc-by-nd", r"cc-by-nd-\d\.\d", ["cc~by~nd", "creative~commons~attribution~no~?deriv(?:ative)?s"], ["creativecommons.org/licenses/by-nd"]),
    ("cc-by", r"cc-by-\d\.\d", ["cc~by", "creative~commons~attribution"], ["creativecommons.org/licenses/by"]),
    ("odbl-1.0", r"odbl-1\.0", ["open~database~licen[cs]e"], ["opendatacommons.org/licenses/odbl"]),
    ("odc-by", r"odc-by-1\.0", ["open~data~commons~attribution~licen[cs]e"], ["opendatacommons.org/licenses/by"]),
    ("pddl-1.0", r"pddl-1\.0", ["public~domain~dedication~and~licen[cs]e"], ["opendatacommons.org/licenses/pddl"]),
    ("ofl-1.1", r"ofl-1\.[01]\S*", ["sil~open~font~licen[cs]e", "open~font~licen[cs]e"], ["scripts.sil.org/ofl", "openfontlicense.org"]),
    ("psf-2.0", r"(?:psf|python)-2\.0", ["python~software~foundation~licen[cs]e", "psf~licen[cs]e"], ["docs.python.org/license"]),
    ("php-3.01", r"php-3\.0\S*", ["php~licen[cs]e"], ["php.net/license"]),
    ("ruby", r"ruby", ["ruby~licen[cs]e"], ["ruby-lang.org/en/about/license"]),
    ("ncsa", r"ncsa", ["university~of~illinois~ncsa~open~source~licen[cs]e", "ncsa~open~source~licen[cs]e"], ["opensource.org/licenses/ncsa"]),
    ("afl-3.0", r"afl-\d\.\d", ["academic~free~licen[cs]e"], ["opensource.org/licenses/afl"]),
    ("osl-3.0", r"osl-\d\.\d", ["open~software~licen[cs]e"], ["opensource.org/licenses/osl"]),
    ("ms-pl", r"ms-pl", ["microsoft~public~licen[cs]e"], ["opensource.org/licenses/ms-pl"]),
    ("ms-rl", r"ms-rl", ["microsoft~reciprocal~licen[cs]e"], ["opensource.org/licenses/ms-rl"]),
    ("openssl", r"openssl", ["openssl~licen[cs]e"], ["openssl.org/source/license"]),
    ("busl-1.1", r"busl-1\.1", ["business~source~licen[cs]e"], ["mariadb.com/bsl11"]),
    ("sspl-1.0", r"sspl-1\.0", ["server~side~public~licen[cs]e"], ["mongodb.com/licensing/server-side-public-license"]),
    ("elastic-2.0", r"elastic-2\.0", ["elastic~licen[cs]e"], ["elastic.co/licensing/elastic-license"]),
    ("postgresql", r"postgresql", ["postgresql~licen[cs]e"], ["opensource.org/licenses/postgresql"]),
    ("public-domain", r"public-domain", ["released~into~the~public~domain", "dedicated~to~the~public~domain"], []),
]


def _words(pattern: str) -> bytes:
    gap = rb"(?:" + _GAP + rb")"
    body = pattern.encode().replace(b"~?", gap + b"?").replace(b"~", gap)
    return rb"(?<!" + _EDGE + rb")" + body + rb"(?!" + _EDGE + rb")"


def _keyword(pattern: str) -> bytes:
    """The longest literal word of a name pattern: a text without it cannot match."""
    words = re.findall(r"[a-z0-9]+", re.sub(r"\(.*?\)\??|\[.*?\]|[a-z0-9]\?", "~", pattern.replace("~?", "~")))
    return max(words, key=len).encode()


class Rule:
    """One signature: detections of lower ``priority`` numbers come first."""

    def __init__(self, priority: int, weight: float, label: str | None, pattern: bytes, keyword: bytes):
        self.priority, self.weight, self.label, self.keyword = priority, weight, label, keyword
        self.regex = re.compile(pattern)


# An SPDX expression runs to the first thing that is neither an id, AND, OR, WITH nor a bracket.
_SPDX_ID = re.compile(rb"[a-z0-9][a-z0-9.+-]*")
_SPDX = rb"spdx-license-identifier:([ \t(]*[a-z0-9][a-z0-9.+-]*(?:[ \t)]+(?:and|or|with)[ \t(]+[a-z0-9][a-z0-9.+-]*)*)"

# Licence texts themselves: label, a wording that only this licence has (words; "~" stands for what separates
# them, "@" for up to forty words in between), and a rare literal of it that the text must hold.
_BODIES = [
    ("mit", "permission~is~hereby~granted~free~of~charge~to~any~person~obtaining~a~copy~of~this~software", "obtaining"),
    ("mit", "the~above~copyright~notice~and~this~permission~notice~shall~be~included~in~all~copies", "notice"),
    ("mit-0", "to~permit~persons~to~whom~the~software~is~furnished~to~do~so~the~software~is~provided~as~is", "furnished"),
    ("x11", "except~as~contained~in~this~notice~the~names?~of@shall~not~be~used~in~advertising", "advertising"),
    ("bsl-1.0", "obtaining~a~copy~of~the~software~and~accompanying~documentation~covered~by~this~license", "accompanying"),
    ("isc", "permission~to~use~copy~modify~and~or~distribute~this~software~for~any~purpose~with~or~without~fee~is~hereby~granted", "distribute"),
    ("postgresql", "software~and~its~documentation~for~any~purpose~without~fee~and~without~a~written~agreement", "agreement"),
    ("bsd", "redistribution~and~use~in~source~and~binary~forms~with~or~without~modification~are~permitted", "redistribution"),
    ("bsd-3-clause", "neither~the~name~of@may~be~used~to~endorse~or~promote~products~derived~from~this~software", "endorse"),
    ("bsd-4-clause", "all~advertising~materials~mentioning~features~or~use~of~this~software~must~display", "advertising"),
    ("apache-2.0", "licensed~under~the~apache~license~version~2~0~the~license~you~may~not~use~this~file~except~in~compliance", "compliance"),
    ("apache-2.0", "unless~required~by~applicable~law~or~agreed~to~in~writing~software~distributed~under~the~license~is~distributed~on~an~as~is~basis", "applicable"),
    ("gpl-2.0", "under~the~terms~of~the~gnu~general~public~license@either~version~2", "gnu"),
    ("gpl-3.0", "under~the~terms~of~the~gnu~general~public~license@either~version~3", "gnu"),
    ("lgpl-2.1", "under~the~terms~of~the~gnu~lesser~general~public~license@version~2~1", "lesser"),
    ("lgpl-3.0", "under~the~terms~of~the~gnu~lesser~general~public~license@version~3", "lesser"),
    ("agpl-3.0", "under~the~terms~of~the~gnu~affero~general~public~license", "affero"),
    ("gfdl", "permission~is~granted~to~copy~distribute~and~or~modify~this~document~under~the~terms~of~the~gnu~free~documentation~license", "document"),
    ("mpl-2.0", "this~source~code~form~is~subject~to~the~terms~of~the~mozilla~public~license~v~2~0", "mozilla"),
    ("mpl-1.1", "the~contents~of~this~file~are~subject~to~the~mozilla~public~license~version~1~1", "mozilla"),
    ("epl-2.0", "made~available~under~the~terms~of~the~eclipse~public~license~(?:v~)?2~0", "eclipse"),
    ("epl-1.0", "made~available~under~the~terms~of~the~eclipse~public~license~v1", "eclipse"),
    ("cddl-1.0", "subject~to~the~terms~of~the~common~development~and~distribution~license", "development"),
    ("zlib", "altered~source~versions~must~be~plainly~marked~as~such~and~must~not~be~misrepresented", "misrepresented"),
    ("unlicense", "this~is~free~and~unencumbered~software~released~into~the~public~domain", "unencumbered"),
    ("wtfpl", "everyone~is~permitted~to~copy~and~distribute~verbatim~or~modified~copies~of~this~license~document~and~changing~it~is~allowed", "verbatim"),
    ("cc0-1.0", "has~waived~all~copyright~and~related~or~neighbou?ring~rights", "waived"),
    ("cc-by", "work~is~licensed~under~a~creative~commons~attribution~\\d", "creative"),
    ("cc-by-sa", "work~is~licensed~under~a~creative~commons~attribution~sharealike", "creative"),
    ("ofl-1.1", "this~font~software~is~licensed~under~the~sil~open~font~license", "font"),
    ("ms-pl", "if~you~bring~a~patent~claim~against~any~contributor~over~patents~that~you~claim~are~infringed~by~the~software", "infringed"),
    ("artistic-2.0", "this~license~establishes~the~terms~under~which~a~given~free~software~package~may~be~copied", "establishes"),
    ("psf-2.0", "psf~hereby~grants~licensee~a~nonexclusive~royalty~free~world~wide~license", "psf"),
    ("openssl", "this~product~includes~software~developed~by~the~openssl~project", "openssl"),
    ("ncsa", "deal~with~the~software~without~restriction~including~without~limitation~the~rights", "restriction"),
    ("eupl-1.2", "licensed~under~the~eupl", "eupl"),
    ("public-domain", "the~author@disclaims~copyright~to~this~source~code", "disclaims"),
    ("proprietary", "all~rights~reserved~unauthori[sz]ed~(?:copying|use|reproduction)", "unauthori"),
    ("proprietary", "confidential~and~proprietary~(?:information~)?of", "proprietary"),
    ("cc-by-nc", "may~not~use~the~material~for~commercial~purposes", "commercial"),
    ("cc-by-nd", "if~you~remix~transform~or~build~upon~the~material~you~may~not~distribute~the~modified~material", "remix"),
]


@lru_cache(maxsize=4096)
def spdx_label(name: bytes) -> str | None:
    """The label of an SPDX id; ``None`` for operators, exceptions and unknown ids."""
    for label, spdx, _, _ in _LICENCES:
        if re.fullmatch(spdx.encode(), name):
            return label
    return None


@lru_cache(maxsize=1)
def signature_rules() -> tuple[Rule, ...]:
    """SPDX expressions, licence texts, addresses, granting notices and names, in that order of priority."""
    rules = [Rule(0, 1.0, None, _SPDX, b"spdx-license")]
    far = rb"(?:" + _GAP + rb"[0-9a-z\x80-\xff]+){0,40}?" + _GAP
    for label, wording, keyword in _BODIES:
        rules.append(Rule(1, 1.0, label, far.join(_words(part) for part in wording.split("@")), keyword.encode()))
    notice = rb"(?:licen[cs]ed|released|distributed|available)" + _GAP + rb"under" + _GAP + rb"(?:the" + _GAP + rb"|a" + _GAP + rb"|terms" + _GAP + rb"of" + _GAP + rb")*"
    for label, _, names, addresses in _LICENCES:
        rules += [Rule(2, 0.9, label, rb"(?:https?://)?(?:www\.)?" + re.escape(a.encode()), a.encode()) for a in addresses]
        for name in names:
            rules.append(Rule(3, 0.9, label, rb"(?<!" + _EDGE + rb")" + notice + _words(name), _keyword(name)))  # its name, then "under"
            rules.append(Rule(4, 0.5, label, _words(name), _keyword(name)))
    return tuple(rules)


@lru_cache(maxsize=1)
def base_rules() -> tuple[tuple[re.Pattern, str, tuple[bytes, ...]], ...]:
    return tuple((re.compile(_words(p.replace(" ", "~"))), label, tuple(p.encode().split())) for p, label in BASE)


def detect(text: bytes) -> list[tuple[int, int, str, float]]:
    """Detections ``(start, end, label, weight)`` of a lower-cased text after suppression, by place."""
    keywords: dict[bytes, bool] = {}
    found = []
    for order, rule in enumerate(signature_rules()):
        here = keywords.get(rule.keyword)
        if here is None:
            here = keywords[rule.keyword] = rule.keyword in text
        if here:
            for m in rule.regex.finditer(text):
                if rule.label is not None:
                    found.append(((rule.priority, m.start() - m.end(), m.start(), order), m.start(), m.end(), rule.label, rule.weight))
                else:  # an SPDX expression: every licence it names
                    for i, name in enumerate(_SPDX_ID.finditer(m[1])):
                        label = spdx_label(name[0])
                        if label:
                            at = m.start(1) + name.start()
                            found.append(((rule.priority, -1 - i, at, order), at, at + len(name[0]), label, rule.weight))
    kept: list[tuple[int, int, str, float]] = []
    starts, ends = [], []  # accepted intervals that lie in no other: both ascend
    for _, start, end, label, weight in sorted(found):
        at = bisect_right(starts, start)
        if at and end <= ends[at - 1]:
            continue
        kept.append((start, end, label, weight))
        low = at - (1 if at and starts[at - 1] == start else 0)
        high = bisect_right(ends, end, lo=low)  # those that the new one holds
        starts[low:high], ends[low:high] = [start], [end]
    return sorted(kept)


def scan_text(text: bytes) -> tuple:
    """``(n_words, n_base, first_word, last_word, base_labels, labels, score)`` of one text."""
    low = text.lower()  # of bytes: A-Z alone
    data = np.frombuffer(low, np.uint8)
    starts, _ = word_bounds(data, NO_WORD)
    at, base = [], set()
    for regex, label, words in base_rules():
        if all(w in low for w in words):
            places = [m.start() for m in regex.finditer(low)]
            if places:
                at += places
                base.add(label)
    found = detect(low)
    labels = base | {label for _, _, label, _ in found}
    score = max([0.5 * bool(base), *(w for *_, w in found)])
    first, last = np.searchsorted(starts, [min(at), max(at)]).tolist() if at else (None, None)
    return len(starts), len(at), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, base places, labels and score."""

    def scan(batches):
        for batch in batches:
            data, bounds = text_bytes(batch.column(1))
            raw = memoryview(data)
            rows = [scan_text(bytes(raw[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, SCHEMA)
