"""A small workbook writer, for fixtures and exports: values, formulas, names and validations."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape, quoteattr

from gridlineage.functions.formula import column_letters

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"


def write(path: str, sheets: dict[str, dict[tuple[int, int], object]], names: dict[str, str] | None = None, values: dict[tuple[str, int, int], object] | None = None, validations: dict[str, list[tuple[str, str]]] | None = None, local_names: list[tuple[str, int, str]] | None = None, chart_first: bool = False, tables: dict[str, list[tuple[str, str, list[str]]]] | None = None) -> None:
    """sheets: name -> {(row, col): value or "=formula"}; values: cached results of formulas; validations: sheet -> (sqref, list formula);
    local_names: (name, place of its tab from 0, text); chart_first: an empty chart sheet as the first tab; tables: sheet -> (name, ref, columns)."""

    def cell(sheet: str, row: int, col: int, v: object) -> str:
        ref = f"{column_letters(col)}{row}"
        formula = ""
        if isinstance(v, str) and v.startswith("="):
            formula = f"<f>{escape(v[1:])}</f>"
            v = (values or {}).get((sheet, row, col))
        if v is None:
            return f'<c r="{ref}">{formula}</c>'
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b">{formula}<v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}">{formula}<v>{v}</v></c>'
        if formula:
            return f'<c r="{ref}" t="str">{formula}<v>{escape(str(v))}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = ['<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>', '<Default Extension="xml" ContentType="application/xml"/>', '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>']
        listed, rels = [], []
        if chart_first:
            z.writestr("xl/chartsheets/sheet1.xml", f'{_HEAD}<chartsheet xmlns="{_MAIN}"/>')
            listed.append('<sheet name="Chart" sheetId="900" r:id="rId900"/>')
            rels.append(f'<Relationship Id="rId900" Type="{_RELS}/chartsheet" Target="chartsheets/sheet1.xml"/>')
        for k, (name, cells) in enumerate(sheets.items(), 1):
            rows: dict[int, list[str]] = {}
            for (r, c), v in sorted(cells.items()):
                rows.setdefault(r, []).append(cell(name, r, c, v))
            body = "".join(f'<row r="{r}">{"".join(cs)}</row>' for r, cs in rows.items())
            rules = "".join(f"<dataValidation type=\"list\" sqref={quoteattr(q)}><formula1>{escape(f)}</formula1></dataValidation>" for q, f in (validations or {}).get(name, []))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData>{f"<dataValidations>{rules}</dataValidations>" if rules else ""}</worksheet>')
            kinds.append(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
            links = []
            for n, (title, ref, columns) in enumerate((tables or {}).get(name, []), 1):
                inner = "".join(f'<tableColumn id="{i}" name={quoteattr(c)}/>' for i, c in enumerate(columns, 1))
                z.writestr(f"xl/tables/table{k}_{n}.xml", f'{_HEAD}<table xmlns="{_MAIN}" id="{n}" name={quoteattr(title)} displayName={quoteattr(title)} ref="{ref}"><tableColumns count="{len(columns)}">{inner}</tableColumns></table>')
                links.append(f'<Relationship Id="rId{n}" Type="{_RELS}/table" Target="../tables/table{k}_{n}.xml"/>')
            if links:
                z.writestr(f"xl/worksheets/_rels/sheet{k}.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACK}/relationships">{"".join(links)}</Relationships>')
            listed.append(f'<sheet name={quoteattr(name)} sheetId="{k}" r:id="rId{k}"/>')
            rels.append(f'<Relationship Id="rId{k}" Type="{_RELS}/worksheet" Target="worksheets/sheet{k}.xml"/>')
        defined = "".join(f"<definedName name={quoteattr(n)}>{escape(t)}</definedName>" for n, t in (names or {}).items())
        defined += "".join(f'<definedName name={quoteattr(n)} localSheetId="{at}">{escape(t)}</definedName>' for n, at, t in local_names or [])
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_RELS}"><sheets>{"".join(listed)}</sheets>{f"<definedNames>{defined}</definedNames>" if defined else ""}</workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACK}/relationships">{"".join(rels)}</Relationships>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACK}/content-types">{"".join(kinds)}</Types>')
