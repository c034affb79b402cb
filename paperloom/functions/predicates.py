"""Boolean classifiers over texts of recognized lines, and the type of a line.

Each is a SQL rule over ``t`` (trimmed text), ``plain`` (lower case, without
accents and without marks around it), ``bare`` (lower case without accents)
and ``confidence``. ``with_predicates`` adds them as columns in stages, so
that one that others build on is evaluated once.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dialect import any_in, column, duck, one_of, rx, split_methods, word_pattern

# Fixed values (the vocabulary that results depend on).
COMPANY_SUFFIXES = (
    "llc", "ltd", "limited", "inc", "inc.", "plc", "sarl", "suarl", "corp", "corporation",
    "company", "co.", "group", "electronics", "services", "distribution", "trading", "industries",
    "interiors", "canada", "tunisie", "pharma", "pharmacy", "medical", "technologies",
    "spa", "sarlau", "clinic", "laboratory", "labs", "logistics", "solutions",
)
TABLE_WORDS = ("description", "designation", "quantity", "qty", "qte", "unit", "unite", "unité", "price", "prix", "total", "amount", "tva", "vat", "net", "gross", "worth")
CUSTOMER_LABELS = ("bill to", "invoice to", "client", "customer", "acheteur", "destinataire", "facture a", "facture à", "facturé à", "livre a", "livré à")
SUPPLIER_LABELS = ("supplier", "seller", "vendor", "bill from", "fournisseur", "vendeur", "from")
PAYMENT_WORDS = ("payment details", "payment", "iban", "rib", "swift", "bank", "banque")
ADDRESS_WORDS = ("street", "st", "road", "rd", "avenue", "ave", "rue", "route", "suite", "unit", "apt", "postal", "zip")
INVOICE_DATE_LABELS = ("invoice date", "date of invoice", "bill date", "date facture", "date d'emission", "date d emission")
DUE_LABELS = ("due date", "date d'echeance", "echeance", "payment due", "date limite", "echéance")
BARE_LABELS = ("ship to", "bill to", "supplier", "seller", "vendor", "customer", "client", "address", "adresse", "phone", "email", "bank")
PARTY_LABELS_ONLY = (
    "ship to", "shipto", "bill to", "billto", "customer", "client", "supplier", "vendor", "seller", "address", "adresse", "bank", "phone", "email",
    "unit price", "quantity", "description", "ship_to", "bill_to", "total", "amount", "po number", "purchase order", "order number",
)
GENERIC_NAMES = ("company", "customer", "supplier", "vendor", "seller", "client", "invoice", "facture", "address", "adresse", "po number", "purchase order", "order number")
PRODUCT_WORDS = ("description", "designation", "quantity", "qty", "qte", "unit price", "unit", "price", "prix", "total", "amount", "vat", "tva", "code produit", "po number", "purchase order", "order number")
TABLE_HEADER_VALUES = ("quantity", "qty", "qte", "unit", "price", "prix", "total", "description", "designation", "montant", "tva", "vat", "ht", "ttc", "tax", "subtotal", "sous-total")
POSTAL = r"^(?:[A-Z]\d[A-Z]\s*\d[A-Z]\d|\d{4,6}|[A-Z]{1,3}\s*\d[A-Z0-9]{2,5})$"


def letters(c: str) -> str:
    return f"length(@rep({c}, {rx('[^' + chr(92) + 'p{L}]')}, ''))"


def label_line(labels) -> str:
    """A line that is a label, begins with one and a mark, or is a short line
    with the one-word label in it."""
    c = "@rstrip(plain, ':')"
    marks = " or ".join(f"@starts({c}, '{x.replace(chr(39), chr(39) * 2)}{m}')" for x in labels for m in (":", " #"))
    short = " or ".join(f"(length({c}) <= {len(x) + 4} and @m({c}, {rx('(^| )' + x + '( |$)')}))" for x in labels if " " not in x) or "false"
    return f"({c} in {one_of(labels)} or {marks} or {short})"


#: Stage by stage: name and rule; a stage may use the columns of those before.
STAGES: list[dict[str, str]] = [
    {"t": "trim(text)", "plain": "@strip(@bare(lower(text)), ' :#|-')", "bare": "@bare(lower(text))"},
    {
        "compact": f"trim(@rep(bare, {rx('[^a-z0-9]+')}, ' '))",
        "n_letters": letters("text"),
        "is_table_header": "(" + " + ".join(f"cast(@m(plain, {word_pattern([w])}) as int)" for w in TABLE_WORDS) + f" >= 3 or @m(plain, {rx(chr(92) + 'bid' + chr(92) + 's*' + chr(92) + '|?' + chr(92) + 's*description' + chr(92) + 'b')}))",
        "is_payment_label": label_line(PAYMENT_WORDS),
        "is_customer_label": label_line(CUSTOMER_LABELS),
        "is_supplier_label": label_line(SUPPLIER_LABELS),
        "is_due_label": label_line(DUE_LABELS),
        "is_postal_code": f"@m(upper(t), {rx(POSTAL)})",
        "is_address": f"(@m(t, {rx('[0-9]')}) and ({any_in('bare', ADDRESS_WORDS)} or @m(upper(t), {rx(r'\b[A-Z][0-9][A-Z]\s*[0-9][A-Z][0-9]\b')})))",
        "is_product_row": f"(not {any_in('bare', ('subtotal', 'total due', 'sales tax', 'shipping'))} and {any_in('bare', TABLE_WORDS)} and @n(bare, {rx('[0-9]')}) >= 2)",
        "has_money_context": any_in("plain", ("total", "tax", "price", "amount", "subtotal")),
        "is_email": f"@m(t, {rx(r'[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+')})",
        "is_total_label": f"(plain in ('total', 'total:') or @m(plain, {rx(r'\b(?:total due|grand total|amount due|balance due|total ttc|invoice total|montant ttc)\b')}))",
        "is_subtotal_label": f"@m(plain, {rx(r'\b(?:subtotal|sub total|sous-total|total ht|h\.t|htva)\b')})",
        "is_tax_label": f"(not @m(plain, {rx(r'\b(?:tax\s*id|taxid|vat\s*(?:number|no\.?|id)|matricule|identifier)\b')}) and @m(plain, {rx(r'\b(?:sales tax|tax|vat|tva)\b')}))",
        "is_date": f"@m(text, {rx(r'\b(?:[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-][0-9]{2,4}|[0-9]{4}[/.\-][0-9]{1,2}[/.\-][0-9]{1,2})\b')})",
        "is_amount": f"(@m(t, {rx('[0-9]')}) and @m(@rep(t, {rx('[^0-9,.-]')}, ''), {rx(r'^-?[0-9.,]*[0-9][0-9.,]*$')}) and (contains(t, '$') or contains(t, '€') or @m(t, {rx(r'[0-9]+[,.][0-9]{2,3}\b')})))",
        "is_contact": f"(@m(bare, {rx(r'@|\b(?:email|e-mail|tel|phone|fax|mobile|gsm)\b')}) or @m(bare, {rx(r'^\s*(?:address|adresse)\s*[:#-]?\s*[0-9]')}) or @m(bare, {rx(r'\b(?:iban|rib|swift|bic|bank|banque|account|compte)\b')})"
        f" or (@m(bare, {rx('[0-9]')}) and @m(bare, {rx(r'\b(?:street|st|road|rd|avenue|ave|rue|route|suite|unit|apt|zip|postal|city|state|tunisie|tunis|sfax|ariana|canada|fpo|apo|uss)\b')}))"
        f" or @m(bare, {rx(r'\b[a-z]{2}\s*[0-9]{4,6}\b')}) or @m(bare, {rx(r'\b[0-9]{4,6}\s*(?:us|usa|tunisie|canada|france)\b')}) or @m(bare, {rx(r'^(?:[a-z][0-9][a-z]\s*[0-9][a-z][0-9]|[0-9]{4,6})$')}))",
        "is_footer": f"@m(bare, {rx(r'\b(?:thank you|merci|conditions|payment terms|signature|received by|prepared by|recu par|reglement|penalit|banque|bank details|coordonnees bancaires)\b')})",
        "is_product_text": f"({any_in('bare', PRODUCT_WORDS)} or (@m(bare, {rx(r'\b[a-z]{2,}[a-z0-9]*-[a-z0-9]+\b')}) and @m(bare, {rx(r'\b[0-9]+(?:mg|ml|gr|kg|g|pcs?|piece)\b')}))"
        f" or (@n(bare, {rx(r'[0-9]+(?:[,.][0-9]+)?')}) >= 2 and @m(bare, {rx(r'\b(?:mg|ml|roll|case|box|boite|piece)\b')})))",
        "has_legal_suffix": f"@m(bare, {rx(r'\b(?:inc|inc\.|ltd|ltd\.|llc|limited|sarl|s\.a\.r\.l|suarl|sa|s\.a|sas|corp|corporation|company|co\.?|gmbh|bv|nv|plc|spa)\b')})",
        "is_negative_section": f"@m(bare, {rx(r'\b(?:subtotal|sous-total|total due|total ttc|amount due|payment|bank|iban|rib|swift|description|quantity|unit price|prix|tva|vat|footer|signature|shipping and handling)\b')})",
        "is_due_context": f"@m(bare, {rx(r'\b(?:due[_\s-]*date|payment due|payable by|date limite|echeance|date d[\x27 ]?echeance|date decheance)\b')})",
        "is_order_context": f"@m(bare, {rx(r'\b(?:order date|purchase order date|po date|date commande|date de commande|commande|delivery date|date livraison|date de livraison|shipping date|ship date|livraison)\b')})",
        "is_document_total": f"@m(bare, {rx(r'\b(?:subtotal|sub total|sous-total|grand total|total due|amount due|balance due|total ttc|total ht|net a payer|invoice total)\b')})",
        "is_product_table": f"({any_in('bare', ('description', 'designation'))} and {any_in('bare', ('qty', 'qte', 'quantity', 'prix', 'price'))} or @n(bare, {rx(r'\b[a-z]{2,}[a-z0-9]*-[a-z0-9]+\b[^0-9]*[0-9]+')}) >= 2)",
        "is_metadata_line": f"@m(lower(text), {rx(r'(invoice|facture|date|due|echeance|échéance|issued|number|n°|no\b|ref)')})",
        "is_totals_line": f"@m(lower(text), {rx(r'(total|ttc|ht|tva|vat|tax|subtotal|sous.?total|remise|discount|shipping|stamp|timbre)')})",
        "is_party_line": f"@m(lower(text), {rx(r'(supplier|vendor|client|customer|bill.?to|livr[ée]|mf|ice|vat|tax|email|tel|phone|address|adresse)')})",
        "is_table_line": f"@m(lower(text), {rx(r'(description|designation|désignation|qty|qte|quantity|prix|price|unit|total|amount|tva|vat)')})",
        "is_row_number": f"@m(t, {rx(r'^0?[0-9]{1,3}$')})",
        "is_wrapped_fragment": f"(not @m(t, {rx('[0-9]')}) and length(t) between 3 and 40 and @m(t, {rx(r'^[a-z(]')}))",
    },
    {
        "is_invoice_label": f"({label_line(INVOICE_DATE_LABELS)} or (@m(plain, {rx(r'\b(?:invoice|facture)\b')}) and @m(plain, {rx(r'\b(?:no|number|numero|#|n°|ref|reference)\b')})))",
        "is_phone": f"(@m(t, {rx(r'(?:\+?[0-9]{1,3}[\s.-]?)?(?:[0-9][\s.-]?){6,}')}) and not has_money_context)",
        "is_forbidden_party": f"(is_postal_code or replace(plain, '_', ' ') in {one_of(BARE_LABELS)} or is_table_header or @m(plain, {word_pattern(PAYMENT_WORDS)}) or @m(plain, {word_pattern(TABLE_WORDS)})"
        f" or is_customer_label or is_supplier_label or @m(plain, {rx(r'@|\b(?:tel|phone|fax|email|date|invoice|facture|total|tax|vat|tva)\b')}) or is_address)",
        "n_alpha_words": f"@cnt(@words(t), @m(w, {rx(r'^\p{L}[^0-9_&|]+$')}))",
        "n_title_words": f"@cnt(@words(t), @m(w, {rx(r'^\p{L}[^0-9_&|]+$')}) and (contains(w, '-') or @m(w, {rx(r'^[A-Z][a-z]{2,}')})))",
        "is_label_only": f"compact in {one_of(PARTY_LABELS_ONLY)}",
        "is_generic_name": f"(compact in {one_of(GENERIC_NAMES)} or length(compact) <= 2)",
        "n_long_words": f"@cnt(@words(bare), length(w) >= 3)",
    },
    {
        "is_company": f"(not is_forbidden_party and n_letters >= 4 and length(t) <= 95 and not @m(t, {rx('^[0-9]')}) and (@m(bare, {word_pattern(COMPANY_SUFFIXES)})"
        f" or @n(t, {rx('[A-Z][A-Z&.]+')}) >= 2 or @n(t, {rx(r'[\x{0600}-\x{06FF}]{2,}')}) >= 2"
        " or (n_letters >= 6 and n_title_words >= 1 and n_alpha_words <= 4 and not is_product_row) or (n_letters >= 8 and n_alpha_words >= 2 and not is_product_row)))",
        "is_legal_company": f"(has_legal_suffix or @m(bare, {rx(r'\b(?:group|distribution|pharma|pharmacy|medical|clinic|trading|industries|technologies|solutions|laboratory|logistics)\b')}) or (n_long_words between 2 and 5 and not is_product_text))",
        "is_invalid_value": f"(plain in {one_of(TABLE_HEADER_VALUES)} or @m(lower(t), {rx('^(?:acct_|cus_|tok_|pi_|cs_)[a-z0-9_-]{8,}$')}) or @m(t, {rx('^[A-Za-z0-9+/=_-]{18,}$')}))",
    },
    {
        "is_noise": f"(coalesce(confidence < 0.35, false) and (length(t) <= 20 or not is_company) or @m(t, {rx(r'^[^\p{L}\p{N}]+$')}))",
        "is_invalid_name": f"(is_invalid_value or @m(t, {rx('^[A-Za-z]{1,3}$')}) or {any_in('plain', ('subtotal', 'sales tax', 'shipping', 'amount due', 'total due', 'quantity', 'description', 'price', 'total', 'montant'))})",
        "party_plausibility": "greatest(0, least(18, case when n_letters >= 0.55 * length(replace(t, ' ', '')) then 8 else 2 end + case when size_of_words between 1 and 6 then 5 else 0 end"
        f" + case when is_legal_company then 7 else 0 end - case when {any_in('bare', ('invoice', 'facture', 'date', 'page', 'total'))} then 8 else 0 end))".replace("size_of_words", "@cnt(@words(t), true)"),
    },
    {
        "node_type": f"case when plain = '' or is_noise then 'random_noise' when is_table_header then 'table_header' when is_payment_label then 'payment_label' when is_email then 'email' when is_phone then 'phone'"
        " when is_total_label then 'total_label' when is_subtotal_label then 'subtotal_label' when is_tax_label then 'tax_label' when is_due_label then 'due_date_label' when is_invoice_label then 'invoice_label'"
        " when is_customer_label then 'customer_label' when is_supplier_label then 'supplier_label' when is_date then 'date_candidate' when is_amount then 'amount' when is_postal_code or is_address then 'address_candidate'"
        f" when is_product_row then 'table_row_text' when is_company then 'company_candidate' when {any_in('plain', ('thank you', 'merci', 'terms', 'conditions', 'signature'))} then 'footer_note'"
        " when length(t) <= 3 then 'random_noise' else 'unknown' end",
    },
]


_NAMES = {name: rule for stage in STAGES[1:] for name, rule in stage.items()}
_NAME = re.compile(r"\b(?:" + "|".join(_NAMES) + r")\b")


#: Marks and all words that a party's text doesn't hold, for one search.
FORBIDDEN_MARKS = rx(r'@|\b(?:tel|phone|fax|email|date|invoice|facture|total|tax|vat|tva)\b')
FORBIDDEN_WORDS = word_pattern((*PAYMENT_WORDS, *TABLE_WORDS))[:-1] + "|" + FORBIDDEN_MARKS[2:-1] + r"|\bid\s*\|?\s*description\b'"


def _without(rule: str, part: str) -> str:
    assert rule.count(part) == 1, part
    return rule.replace(part, "")


@functools.cache
def _whole(name: str) -> str:
    """The rule of ``name`` over t, plain and bare alone, others written out, so
    that each is evaluated only where the ones before it leave a line open.
    ``plain`` ends in no colon; of a header's words one is sought before all;
    words that no party has are sought at once (a header holds some of them),
    and only in texts of a company's length."""
    rule = _NAMES[name].replace("@rstrip(plain, ':')", "plain")
    if name == "is_table_header":
        count, rest = rule[1:].split(" or ", 1)
        rule = f"(@m(plain, {word_pattern(TABLE_WORDS)}) and {count} or {rest}"
    if name == "is_forbidden_party":
        for part in ("is_table_header or ", f"@m(plain, {word_pattern(PAYMENT_WORDS)}) or ", f" or @m(plain, {FORBIDDEN_MARKS})"):
            rule = _without(rule, part)
        rule = rule.replace(f"@m(plain, {word_pattern(TABLE_WORDS)})", f"@m(plain, {FORBIDDEN_WORDS})")
    if name == "is_company":
        rule = _without(rule, "not is_forbidden_party and ").replace(" and (@m(bare, ", " and not is_forbidden_party and (@m(bare, ", 1)
    return "(" + _NAME.sub(lambda m: _whole(m[0]), rule) + ")"


def with_predicates(lines: DataFrame, *names: str) -> DataFrame:
    """``lines`` (text, confidence) with the predicates ``names``, or all.

    What all rules read comes from a generator of one row: filters aren't
    pushed below it, so a line's text is folded once and not for each rule."""
    split_methods(lines.sparkSession)
    rows = lines.withColumn("folded", column(STAGES[0]["bare"]))
    first = {"t": STAGES[0]["t"], "plain": STAGES[0]["plain"].replace(STAGES[0]["bare"], "folded"), "bare": "folded"}
    rows = rows.select(*lines.columns, F.inline(F.array(F.struct(*[column(rule).alias(name) for name, rule in first.items()]))))
    keep = names or (*STAGES[0], *_NAMES)
    return rows.select(*lines.columns, *[F.col(n) if n in STAGES[0] else column(_whole(n)).alias(n) for n in keep])


def predicate_sql(source: str) -> str:
    """The same stages as common table expressions named p0, p1, ..."""
    out = []
    for i, stage in enumerate(STAGES):
        out.append(f"p{i} as (select *, " + ", ".join(f"{duck(rule)} as {name}" for name, rule in stage.items()) + f" from {f'p{i - 1}' if i else source})")
    return ", ".join(out)
