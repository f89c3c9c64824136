"""The seven shipped tables."""

from __future__ import annotations

from csvharbor.functions.cells import normalize_us_state
from csvharbor.specs import FieldSpec, FieldType, Registry, TableSpec

# Table key | group | label | directory | unique key, then the columns in file order.
# A column is text unless a type follows its name after a colon; "> x" names the stored column.
TABLES = """
sfdc_customers | SFDC | Customers | Customers | account_id_casesafe
  account_id_casesafe; account_name; last_activity: date; type

sfdc_price_book | SFDC | Price Book | PriceBook | product_id_casesafe
  price_book_name; list_price: numeric; product_name; product_code; product_id_casesafe

sfdc_opp_detail | SFDC | Opp Detail | OppDetail | opportunity_product_casesafe_id
  opportunity_id; opportunity_product_casesafe_id; opportunity_name; account_name
  close_date: date; booked_date: date; fiscal_period; payment_schedule; payment_due
  contract_start_date: date; contract_end_date: date; term_in_months_deprecated: numeric
  product_name; deployment_type; amount: numeric; quantity: numeric; list_price: numeric
  sales_price: numeric; total_price: numeric; start_date: date; end_date: date
  term_in_months: numeric; product_code; total_amount_due_customer: numeric
  total_amount_due_partner: numeric; active_product: bool

ns_customers | NS | Customers | Customers | internal_id
  salesforce_id_io; internal_id; name; duplicate; company_name; balance: numeric
  unbilled_orders: numeric; overdue_balance: numeric; days_overdue: numeric

ns_so_detail | NS | SO Detail | SoDetail | sfdc_opp_id, sfdc_opp_line_id
  sfdc_opp_id; sfdc_opp_line_id; customer_internal_id; product_internal_id; customer_project
  so_number; document_date: date; start_date: date; end_date: date; item_name; item_display_name
  line_start_date: date; line_end_date: date; quantity: numeric; unit_price: numeric
  amount_gross: numeric; terms_days_till_net_due: numeric

ns_invoice_detail | NS | Invoice Detail | InvoiceDetail | sfdc_opp_id, sfdc_opp_line_id
  sfdc_opp_id; sfdc_opp_line_id; sfdc_pricebook_id; customer_internal_id; product_internal_id
  type; date: date; date_due: date; document_number; name; memo; item; qty: numeric
  contract_quantity: numeric; unit_price: numeric; amount: numeric; start_date_line: date
  end_date_line_level: date; account; shipping_address_city; shipping_address_state
  shipping_address_country

anrok_transactions | Anrok | Transactions | Transactions | Transaction ID
  Transaction ID; Customer ID; Customer name
  Overall VAT ID validation status > overall_vat_id_status; Valid VAT IDs; Other VAT IDs
  Invoice date: date; Tax date: date; Transaction currency; Sales amount: numeric
  Exempt reasons > exempt_reason; Tax amount: numeric; Invoice amount: numeric; Void: bool
  Customer address line 1; Customer address city; Customer address region
  Customer address postal code; Customer address country; Customer country code
  Jurisdictions; Jurisdictions IDs > jurisdiction_ids; Return IDs
"""
NORMALIZED = {("ns_invoice_detail", "shipping_address_state"): normalize_us_state}
BLANK_KEPT = {("ns_so_detail", "customer_project")}


def _field(table: str, text: str) -> FieldSpec:
    text, _, stored = (part.strip() for part in text.partition(">"))
    name, _, kind = (part.strip() for part in text.partition(":"))
    return FieldSpec(
        name,
        FieldType(kind or "text"),
        db_column=stored or None,
        normalizer=NORMALIZED.get((table, name)),
        not_null=(table, name) in BLANK_KEPT,
    )


def shipped_registry() -> Registry:
    registry = Registry()
    for block in TABLES.strip().split("\n\n"):
        head, *lines = block.splitlines()
        key, group, label, directory, unique = (part.strip() for part in head.split("|"))
        names = [c for line in lines for c in line.split(";")]
        registry.register(
            TableSpec(
                key,
                group,
                label,
                directory,
                tuple(u.strip() for u in unique.split(",")),
                tuple(_field(key, c) for c in names),
            )
        )
    return registry
