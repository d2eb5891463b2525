"""License detection by ordered signature rules.

Rules are regular expressions over the lower-cased text. A keyword automaton passes
over each text once and says which rules can match; only those are tried. Overlapping
detections are resolved by priority, then length: a detection that lies within a
stronger one is dropped. Fixed phrases are counted besides, and their labels stay.

Defined results: a null or empty text has no words and no labels and score 0; rows
repeated with the same doc_id are scanned each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from platewise.llm.common import LOWER, flat, plain, slices, word_spans

# Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_SCORE = {"cc-by": 0.7, "gpl": 0.9, "reserved": 0.5}

# Name of a license: label | keyword every match contains | expression. "~" stands for a gap between words.
NAMES = r"""
mit | mit | mit~licen[cs]e
mit-0 | mit | mit~(?:no~attribution|0)(?:~licen[cs]e)?
x11 | x11 | x11~licen[cs]e
expat | expat | expat~licen[cs]e
apache-1.0 | apache | apache(?:~software)?~licen[cs]e,?~(?:version~|v\.?~?)?1\.0
apache-1.1 | apache | apache(?:~software)?~licen[cs]e,?~(?:version~|v\.?~?)?1\.1
apache-2.0 | apache | apache(?:~software)?(?:~foundation)?~licen[cs]e,?~\(?(?:version~|v\.?~?)?2(?:\.0)?
apache-2.0 | apache | apache~2(?:\.0)?~licen[cs]e
apache | apache | apache(?:~software)?~licen[cs]e
bsd-2-clause | bsd | (?:simplified~bsd|freebsd|bsd~2~clause|two~clause~bsd|2~clause~bsd)~licen[cs]e
bsd-3-clause | bsd | (?:new~bsd|revised~bsd|modified~bsd|bsd~3~clause|three~clause~bsd|3~clause~bsd)~licen[cs]e
bsd-4-clause | bsd | (?:original~bsd|old~bsd|bsd~4~clause|four~clause~bsd|4~clause~bsd)~licen[cs]e
0bsd | bsd | (?:zero~clause~bsd|bsd~zero~clause|bsd~0~clause)(?:~licen[cs]e)?
bsd | bsd | bsd(?:~style)?~licen[cs]e
gpl-1.0 | gen | gnu~general~public~licen[cs]e,?~(?:version~|v\.?~?)1
gpl-2.0-or-later | gen | general~public~licen[cs]e.{0,120}?version~2(?:~of~the~licen[cs]e)?,?~or~\(?at~your~option\)?~any~later
gpl-2.0 | gen | gnu~general~public~licen[cs]e,?~(?:version~|v\.?~?)2
gpl-3.0-or-later | gen | general~public~licen[cs]e.{0,120}?version~3(?:~of~the~licen[cs]e)?,?~or~\(?at~your~option\)?~any~later
gpl-3.0 | gen | gnu~general~public~licen[cs]e,?~(?:version~|v\.?~?)3
gpl | gpl | (?<![al])gpl(?:~?v?[123](?:\.0)?\+?)?~licen[cs]ed?
gpl | gen | gnu~general~public~licen[cs]e
lgpl-2.0 | gen | gnu~library~general~public~licen[cs]e
lgpl-2.1 | gen | (?:gnu~)?lesser~general~public~licen[cs]e,?~(?:version~|v\.?~?)2\.1
lgpl-3.0 | gen | (?:gnu~)?lesser~general~public~licen[cs]e,?~(?:version~|v\.?~?)3
lgpl | gen | (?:gnu~)?lesser~general~public~licen[cs]e
lgpl | lgpl | lgpl(?:~?v?[23](?:\.[01])?\+?)?~licen[cs]ed?
agpl-3.0 | gen | (?:gnu~)?affero~general~public~licen[cs]e,?~(?:version~|v\.?~?)3
agpl | gen | (?:gnu~)?affero~general~public~licen[cs]e
agpl | agpl | agpl(?:~?v?[13](?:\.0)?\+?)?~licen[cs]ed?
gfdl-1.1 | free~doc | gnu~free~documentation~licen[cs]e,?~(?:version~|v\.?~?)1\.1
gfdl-1.2 | free~doc | gnu~free~documentation~licen[cs]e,?~(?:version~|v\.?~?)1\.2
gfdl-1.3 | free~doc | gnu~free~documentation~licen[cs]e,?~(?:version~|v\.?~?)1\.3
gfdl | free~doc | (?:gnu~)?free~documentation~licen[cs]e
mpl-1.0 | mozilla | mozilla~public~licen[cs]e,?~(?:version~|v\.?~?)1\.0
mpl-1.1 | mozilla | mozilla~public~licen[cs]e,?~(?:version~|v\.?~?)1\.1
mpl-2.0 | mozilla | mozilla~public~licen[cs]e,?~(?:version~|v\.?~?)2(?:\.0)?
mpl | mozilla | mozilla~public~licen[cs]e
epl-1.0 | eclipse | eclipse~public~licen[cs]e,?~(?:version~|v\.?~?|-~)?1\.0
epl-2.0 | eclipse | eclipse~public~licen[cs]e,?~(?:version~|v\.?~?|-~)?2\.0
epl | eclipse | eclipse~public~licen[cs]e
edl-1.0 | eclipse | eclipse~distribution~licen[cs]e
cddl-1.0 | common~dev | common~development~and~distribution~licen[cs]e(?:,?~\(?cddl\)?)?,?~(?:version~|v\.?~?)1\.0
cddl-1.1 | common~dev | common~development~and~distribution~licen[cs]e(?:,?~\(?cddl\)?)?,?~(?:version~|v\.?~?)1\.1
cddl | common~dev | common~development~and~distribution~licen[cs]e
cpl-1.0 | common~public | common~public~licen[cs]e
ipl-1.0 | ibm | ibm~public~licen[cs]e
cpal-1.0 | attribution | common~public~attribution~licen[cs]e
osl-3.0 | open~software | open~software~licen[cs]e
afl-3.0 | academic | academic~free~licen[cs]e
ecl-2.0 | educational | educational~community~licen[cs]e
artistic-2.0 | artistic | artistic~licen[cs]e,?~(?:version~|v\.?~?)?2(?:\.0)?
artistic-1.0 | artistic | artistic~licen[cs]e
clarified-artistic | artistic | clarified~artistic~licen[cs]e
isc | isc | isc~licen[cs]e
zlib | zlib | zlib(?:/libpng)?~licen[cs]e
libpng | libpng | libpng~licen[cs]e
libpng | reference | png~reference~library~licen[cs]e
unlicense | unlicen | (?:the~)?unlicen[cs]e
wtfpl | want~to | do~what~the~f[\w*]{3}~you~want~to~public~licen[cs]e
wtfpl | wtfpl | wtfpl
bsl-1.0 | boost | boost~software~licen[cs]e
busl-1.1 | business | business~source~licen[cs]e
sspl-1.0 | server~side | server~side~public~licen[cs]e
elastic-2.0 | elastic | elastic~licen[cs]e
commons-clause | commons | commons~clause
polyform | polyform | polyform~(?:noncommercial|small~business|shield|strict|perimeter|internal~use)~licen[cs]e
python-2.0 | python | python~software~foundation~licen[cs]e
python | python | python~licen[cs]e
ruby | ruby | ruby~licen[cs]e
php-3.01 | php | php~licen[cs]e
perl | perl | same~terms~as~perl
openssl | openssl | openssl~licen[cs]e
ssleay | ssleay | (?:original~)?ssleay~licen[cs]e
postgresql | postgresql | postgresql~licen[cs]e
ncsa | ncsa | (?:university~of~illinois/)?ncsa~open~source~licen[cs]e
w3c | w3c | w3c~(?:software|document)(?:~notice)?(?:~and)?~licen[cs]e
eupl-1.2 | european~union | european~union~public~licen[cs]e,?~(?:version~|v\.?~?)1\.2
eupl | european~union | european~union~public~licen[cs]e
cecill | cecill | cecill(?:-[bc])?
ms-pl | microsoft | microsoft~public~licen[cs]e
ms-rl | microsoft | microsoft~reciprocal~licen[cs]e
apsl | apple | apple~public~source~licen[cs]e
intel | intel | intel~open~source~licen[cs]e
nokia | nokia | nokia~open~source~licen[cs]e
npl | netscape | netscape~public~licen[cs]e
qpl-1.0 | q~public | q~public~licen[cs]e
sissl | sun~industry | sun~industry~standards~source~licen[cs]e
spl-1.0 | sun~public | sun~public~licen[cs]e
sleepycat | sleepycat | sleepycat~licen[cs]e
vim | vim | vim~licen[cs]e
zpl | zope | zope~public~licen[cs]e
ofl-1.1 | font | (?:sil~)?open~font~licen[cs]e
ufl-1.0 | font | ubuntu~font~licen[cs]e
bitstream-vera | bitstream | bitstream~vera(?:~fonts)?~licen[cs]e
lppl | latex | latex~project~public~licen[cs]e
ogl-uk | government | open~government~licen[cs]e
odbl | open~data | open~database~licen[cs]e
odc-by | open~data | open~data~commons~attribution~licen[cs]e
pddl | public~domain | public~domain~dedication~and~licen[cs]e
cdla-permissive | community~data | community~data~licen[cs]e~agreement.{0,4}permissive
cdla-sharing | community~data | community~data~licen[cs]e~agreement.{0,4}sharing
openrail | rail | (?:creativeml~|bigscience~)?open~?rail(?:-?[ms])*~licen[cs]e
llama | llama | llama(?:~\d(?:\.\d)?)?~community~licen[cs]e
cc0-1.0 | cc0 | cc0(?:~1\.0)?(?:~universal)?
cc-by-nc-nd | creative~commons | creative~commons~attribution~non~?commercial~no~?deriv\w*
cc-by-nc-sa | creative~commons | creative~commons~attribution~non~?commercial~share~?alike
cc-by-nc | creative~commons | creative~commons~attribution~non~?commercial
cc-by-nd | creative~commons | creative~commons~attribution~no~?deriv\w*
cc-by-sa | creative~commons | creative~commons~attribution~share~?alike
cc-by | creative~commons | creative~commons~attribution
cc | creative~commons | creative~commons~licen[cs]e
cc-by-nc-nd | cc | \bcc~by~nc~nd\b
cc-by-nc-sa | cc | \bcc~by~nc~sa\b
cc-by-nc | cc | \bcc~by~nc\b
cc-by-nd | cc | \bcc~by~nd\b
cc-by-sa | cc | \bcc~by~sa\b
cc-by | cc | \bcc~by(?:~[1234]\.0)?\b
"""
# Identifiers that follow a license tag, one rule each.
TAGS = """
mit mit-0 x11 isc 0bsd bsd-2-clause bsd-3-clause bsd-4-clause bsd-3-clause-clear apache-1.1 apache-2.0 gpl-1.0-only
gpl-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0-only gpl-3.0-or-later lgpl-2.0-only lgpl-2.1 lgpl-2.1-only
lgpl-2.1-or-later lgpl-3.0 lgpl-3.0-only lgpl-3.0-or-later agpl-3.0 agpl-3.0-only agpl-3.0-or-later mpl-1.1 mpl-2.0
epl-1.0 epl-2.0 cddl-1.0 cddl-1.1 artistic-2.0 bsl-1.0 zlib unlicense wtfpl cc0-1.0 cc-by-3.0 cc-by-4.0 cc-by-sa-3.0
cc-by-sa-4.0 cc-by-nc-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-nc-nd-4.0 ofl-1.1 odbl-1.0 pddl-1.0 eupl-1.2 ncsa
postgresql python-2.0 php-3.01 ms-pl ms-rl upl-1.0 blueoak-1.0.0 busl-1.1 sspl-1.0 elastic-2.0 mulanpsl-2.0 vim
""".split()
# Addresses of license texts.
URLS = r"""
mit | opensource\.org/licen[cs]es/mit
bsd-2-clause | opensource\.org/licen[cs]es/bsd-2-clause
bsd-3-clause | opensource\.org/licen[cs]es/bsd-3-clause
bsd | opensource\.org/licen[cs]es/bsd
isc | opensource\.org/licen[cs]es/isc
zlib | opensource\.org/licen[cs]es/zlib
artistic-2.0 | opensource\.org/licen[cs]es/artistic-2\.0
apache-2.0 | apache\.org/licen[cs]es/licen[cs]e-2\.0
apache | apache\.org/licen[cs]es
gpl-2.0 | gnu\.org/licen[cs]es/(?:old-licen[cs]es/)?gpl-2\.0
gpl-3.0 | gnu\.org/licen[cs]es/gpl-3\.0
gpl | gnu\.org/(?:licen[cs]es|copyleft)/gpl
lgpl-2.1 | gnu\.org/licen[cs]es/(?:old-licen[cs]es/)?lgpl-2\.1
lgpl | gnu\.org/(?:licen[cs]es|copyleft)/lesser
agpl-3.0 | gnu\.org/licen[cs]es/agpl
gfdl | gnu\.org/(?:licen[cs]es|copyleft)/fdl
mpl-2.0 | mozilla\.org/(?:en-us/)?mpl/2\.0
mpl-1.1 | mozilla\.org/mpl/mpl-1\.1
epl-1.0 | eclipse\.org/legal/epl-v10
epl-2.0 | eclipse\.org/legal/epl-(?:v20|2\.0)
bsl-1.0 | boost\.org/licen[cs]e_1_0
unlicense | unlicense\.org
wtfpl | wtfpl\.net
ofl-1.1 | scripts\.sil\.org/ofl
cc0-1.0 | creativecommons\.org/publicdomain/zero
public-domain | creativecommons\.org/publicdomain/mark
cc-by-nc-nd | creativecommons\.org/licen[cs]es/by-nc-nd
cc-by-nc-sa | creativecommons\.org/licen[cs]es/by-nc-sa
cc-by-nc | creativecommons\.org/licen[cs]es/by-nc
cc-by-nd | creativecommons\.org/licen[cs]es/by-nd
cc-by-sa | creativecommons\.org/licen[cs]es/by-sa
cc-by | creativecommons\.org/licen[cs]es/by
odbl | opendatacommons\.org/licen[cs]es/odbl
odc-by | opendatacommons\.org/licen[cs]es/by
"""
# Sentences of license texts and notices: label | keyword | expression.
PHRASES = r"""
mit | permission~is | permission~is~hereby~granted,?~free~of~charge,?~to~any~person~obtaining~a~copy
isc | permission~to | permission~to~use,?~copy,?~modify,?~and/?~?(?:or)?~?distribute~this~software~for~any~purpose
bsd | redistribution | redistribution~and~use~in~source~and~binary~forms
bsd-3-clause | neither~the | neither~the~name~of.{1,80}?endorse~or~promote~products
bsd-4-clause | advertising | all~advertising~materials~mentioning~features~or~use~of~this~software
zlib | altered | altered~source~versions~must~be~plainly~marked
gpl | free~software | this~program~is~free~software.{0,10}you~can~redistribute~it
gpl | copyleft | (?:strong~|weak~)?copyleft~licen[cs]e
lgpl | free~software | this~library~is~free~software.{0,10}you~can~redistribute~it
apache-2.0 | you~may | you~may~not~use~this~file~except~in~compliance~with~the~licen[cs]e
as-is | as~is | (?:provided|distributed)(?:~by~.{1,60}?)?~(?:on~an~)?.{0,2}as~is
unlicense | unencumbered | free~and~unencumbered~software~released~into~the~public~domain
public-domain | public~domain | (?:in|into|to)~the~public~domain
public-domain | public~domain | public~domain~(?:work|dedication|mark)
cc | some~rights | some~rights~reserved
reserved | rights | all~rights~reserved
reserved | rechte | alle~rechte~vorbehalten
reserved | derechos | todos~los~derechos~reservados
reserved | droits | tous~droits~r.{1,2}serv.{1,2}s
proprietary | proprietary | proprietary~and~confidential
proprietary | proprietary | (?:is|are)~proprietary~to
proprietary | unauthori | unauthori[sz]ed~(?:copying|reproduction|distribution|use)~(?:of~this~\w+|or~\w+)
proprietary | end~user | end~user~licen[cs]e~agreement
proprietary | trade~secret | trade~secrets?~of
proprietary | may~not | may~not~be~(?:reproduced|copied|redistributed|republished)
non-commercial | commercial | (?:for|to)~non~?commercial~(?:use|purposes?)(?:~only)?
non-commercial | commercial | not~for~commercial~use
personal-use | personal | for~personal~use~only
research-only | research | for~research(?:~and~(?:research|educational))?~(?:use|purposes)~only
research-only | academic | for~academic(?:~and~(?:research|educational))?~(?:use|purposes)~only
copyright | copyright | copyright~(?:\(c\)|\xc2\xa9)?~?(?:19|20)\d\d(?:~?[-,]~?(?:19|20)?\d\d)*
copyright | (c) | \(c\)~(?:19|20)\d\d
copyright | \xa9 | \xa9~?(?:19|20)\d\d
licensed | licen | (?:is|are)~licen[cs]ed~under
license-file | licen | see~(?:the~)?(?:accompanying~)?licen[cs]e(?:~file|\.txt|\.md)
"""
GAP = r"[^a-z0-9\x80-\xff]{1,6}"
# A rule's kind gives its priority and how sure a detection is.
KINDS = {"tag": (5, 0.98), "url": (4, 0.9), "name": (3, 0.85), "phrase": (2, 0.6)}


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    keyword: str
    pattern: str
    kind: str


def _lines(text: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(" | ")] for line in text.strip().splitlines()]


def _keyword(text: str) -> str:
    """The longest part of a keyword without a gap, as it stands in the text."""
    word = max(text.split("~"), key=len)
    return word.encode().decode("unicode_escape") if "\\" in word else word


def rules() -> list[Rule]:
    """All rules in order."""
    made = []
    for tag in TAGS:
        made.append((tag, "licen", r"licen[cs]e(?:~identifier)?\s{0,3}[:=]\s{0,3}[\"']?" + re.escape(tag) + r"(?![a-z0-9.-]*[a-z0-9])", "tag"))
    made += [(label, max(re.split(r"[\\\[\](?:)|]+", pattern.split("/")[0]), key=len), pattern, "url") for label, pattern in _lines(URLS)]
    made += [(label, word, r"(?<![a-z0-9])" + pattern, "name") for label, word, pattern in _lines(NAMES)]
    made += [(*line, "phrase") for line in _lines(PHRASES)]
    return [Rule(i, label, _keyword(word), pattern.replace("~", GAP), kind) for i, (label, word, pattern, kind) in enumerate(made)]


def resolved(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections that no stronger one contains.

    Stronger is higher priority, then the longer span, then the earlier rule. A
    detection within the span of one at least as strong is dropped.
    """
    found = sorted(found, key=lambda d: (-KINDS[d[2].kind][0], d[0] - d[1], d[2].order, d[0]))
    kept: list[tuple[int, int, Rule]] = []
    starts: dict[int, int] = {}  # furthest end of a kept span by its start
    for start, end, rule in found:
        if not any(s <= start and e >= end for s, e in starts.items()):
            kept.append((start, end, rule))
            starts[start] = max(end, starts.get(start, 0))
    return sorted(kept, key=lambda d: (d[0], d[1], d[2].order))


class Scanner:
    """Compiled rules behind one keyword automaton."""

    def __init__(self, given: list[Rule] | None = None):
        import ahocorasick

        self.rules = rules() if given is None else given
        self.compiled = [re.compile(r.pattern, re.DOTALL) for r in self.rules]
        by_word: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            by_word.setdefault(rule.keyword, []).append(i)
        inside, outside = r"[0-9a-z\x80-\xff]", r"[^0-9a-z\x80-\xff]"
        self.base = []
        for i, (phrase, label) in enumerate(BASE.items()):
            words = phrase.split()
            pattern = f"(?<!{inside})" + f"{outside}+".join(words) + f"(?!{inside})"
            self.base.append((label, re.compile(pattern)))
            by_word.setdefault(max(words, key=len), []).append(-1 - i)
        self.automaton = ahocorasick.Automaton()
        for word, which in by_word.items():
            self.automaton.add_word(word, tuple(which))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[list[tuple[int, str]], list[tuple[int, int, Rule]]]:
        """Places of the fixed phrases, and the resolved detections. The text is lower-cased, one character a byte."""
        which = {i for _, hit in self.automaton.iter(text) for i in hit}
        if not which:
            return [], []
        base = [(m.start(), label) for i, (label, p) in enumerate(self.base) if -1 - i in which for m in p.finditer(text)]
        found = [(m.start(), m.end(), self.rules[i]) for i in which if i >= 0 for m in self.compiled[i].finditer(text)]
        return base, resolved(found)


FORM = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "spans array<struct<start: bigint, end: bigint, label: string, rule: int>>"
)


def detections(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts, labels, score and the spans (in bytes) of the rules' detections."""

    def run(batches):
        scanner = Scanner()
        inside = np.zeros(256, bool)
        inside[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
        for batch in slices(batches):
            data, offsets = flat(batch.column("text"))
            data = LOWER[data]
            starts, _, upto = word_spans(data, offsets, inside[data])
            rows = []
            for i in range(batch.num_rows):
                base, found = scanner.scan(data[offsets[i] : offsets[i + 1]].tobytes().decode("latin-1"))
                at = np.searchsorted(starts, offsets[i] + np.asarray([p for p, _ in base], np.int64)) - upto[i]
                own = {label for _, label in base}
                sure = {r.label: 1 - KINDS[r.kind][1] for _, _, r in reversed(found)} | {x: 1 - BASE_SCORE[x] for x in own}
                rows.append(
                    {
                        "n_words": int(upto[i + 1] - upto[i]),
                        "n_base": len(base),
                        "first_word": int(at.min()) if base else None,
                        "last_word": int(at.max()) if base else None,
                        "base_labels": ",".join(sorted(own)),
                        "labels": ",".join(sorted(set(sure))),
                        "score": 1 - float(np.prod([sure[x] for x in sorted(sure)])) if sure else 0.0,
                        "spans": [{"start": s, "end": e, "label": r.label, "rule": r.order} for s, e, r in found],
                    }
                )
            made = pa.RecordBatch.from_pylist(rows, schema)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made.columns], ["doc_id", *made.schema.names])

    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rule", pa.int32())])
    whole = [(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")]
    schema = pa.schema([*whole, ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return plain(docs).mapInArrow(run, f"doc_id {id_type}, {FORM}")
