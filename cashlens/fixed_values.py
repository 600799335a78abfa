"""Fixed values the results depend on: enumerations, lookup tables, labels, rates.

Everything here is plain data, each table well under 200 entries.
"""

# --- ledger enumerations -------------------------------------------------------------------
SOURCES = ["stripe", "adyen", "ach", "wire", "plaid", "manual_journal"]
TYPES = ["charge", "refund", "payout", "fee", "transfer", "invoice_payment", "adjustment"]
STATUSES = ["succeeded", "failed", "pending", "disputed", "canceled"]
CURRENCIES = ["USD", "EUR", "GBP", "CAD", "AUD", "JPY"]
PRODUCT_LINES = ["subscriptions", "professional_services", "marketplace", "ecommerce", "platform_fees"]
DEPARTMENTS = ["engineering", "sales", "marketing", "g&a", "operations", "support"]
ACCOUNT_CODES = {
    "subscriptions": "4000-revenue",
    "professional_services": "4100-revenue",
    "marketplace": "4200-revenue",
    "ecommerce": "4300-revenue",
    "platform_fees": "4400-revenue",
}
DISPUTE_STATUSES = ["warning_needs_response", "warning_under_review", "won", "lost"]
DECLINE_CODES = [
    "insufficient_funds",
    "card_declined",
    "expired_card",
    "incorrect_cvc",
    "processing_error",
    "call_issuer",
    "pickup_card",
    "restricted_card",
    "lost_card",
    "stolen_card",
    "suspected_fraud",
    "velocity_exceeded",
    "do_not_honor",
    "generic_decline",
    "authentication_required",
]
CARD_BRANDS = ["Visa", "Mastercard", "American Express", "Discover", "JCB"]
CARD_FUNDING = ["credit", "debit", "prepaid"]

REVENUE_TYPES = ["charge", "invoice_payment"]
SIGNED_OUTFLOW_TYPES = ["refund", "payout", "fee"]
OUTFLOW_TYPES = ["refund", "payout", "fee", "transfer", "adjustment"]
EXPENSE_TYPES = ["refund", "fee", "payout", "transfer"]

# --- ingestion -----------------------------------------------------------------------------
EVENT_TYPES = {
    "charge.succeeded": "charge",
    "charge.failed": "charge",
    "charge.refunded": "refund",
    "refund.created": "refund",
    "payout.created": "payout",
    "payout.paid": "payout",
    "payout.failed": "payout",
    "invoice.payment_succeeded": "invoice_payment",
    "invoice.payment_failed": "invoice_payment",
    "transfer.created": "transfer",
}
EVENT_STATUSES = {
    "succeeded": "succeeded",
    "failed": "failed",
    "pending": "pending",
    "canceled": "canceled",
}
BANK_CATEGORIES = {
    "INCOME_WAGES": ("invoice_payment", "professional_services"),
    "INCOME_DIVIDENDS": ("charge", "investments"),
    "INCOME_INTEREST": ("charge", "investments"),
    "PAYMENT_CREDIT_CARD": ("transfer", "financing"),
    "LOAN_PAYMENT": ("transfer", "financing"),
    "RENT": ("charge", "operations"),
    "UTILITIES": ("charge", "operations"),
    "INSURANCE": ("charge", "operations"),
    "TAXES": ("charge", "g&a"),
    "TRAVEL": ("charge", "sales"),
    "MEALS": ("charge", "sales"),
    "OFFICE_SUPPLIES": ("charge", "g&a"),
    "SOFTWARE_SUBSCRIPTIONS": ("charge", "engineering"),
    "PROFESSIONAL_SERVICES": ("charge", "professional_services"),
    "ADVERTISING": ("charge", "marketing"),
    "PAYROLL": ("charge", "operations"),
    "BANK_FEES": ("fee", "g&a"),
}
BANK_CATEGORY_DEFAULT = ("charge", "operations")
BANK_SYNC_CODES = [
    "SYNC_UPDATES_AVAILABLE",
    "INITIAL_UPDATE_COMPLETE",
    "HISTORICAL_UPDATE_COMPLETE",
]
BANK_REMOVAL_CODE = "TRANSACTIONS_REMOVED"
ENTRY_DEFAULTS = {
    "product_line": "subscriptions",
    "department": "engineering",
    "account_code": "4000-revenue",
    "cost_center": "CC-ENG-001",
}
CARD_FEE_RATE = 0.029
CARD_FEE_FIXED_CENTS = 30
RECURRING_PATTERN = "(?i)recur|subscription|monthly"
MERGE_UPDATE_COLUMNS = [
    "status",
    "posted_at",
    "posted_date",
    "net_amount",
    "fee_amount",
    "dispute_id",
    "dispute_status",
    "ingested_at",
    "batch_id",
]

# --- display labels ------------------------------------------------------------------------
MONTH_NAMES = [
    "January",
    "February",
    "March",
    "April",
    "May",
    "June",
    "July",
    "August",
    "September",
    "October",
    "November",
    "December",
]
DEPARTMENT_LABELS = {
    "engineering": "Engineering & R&D",
    "sales": "Sales & Account Exec",
    "g&a": "General & Administrative",
    "marketing": "Growth & Marketing",
    "operations": "Operations & Infrastructure",
    "support": "Customer Support & Success",
}
FILTER_DEPARTMENT_LABELS = {
    "engineering": "Engineering & R&D",
    "sales": "Sales & Growth",
    "g&a": "General & Administrative",
    "marketing": "Marketing",
    "operations": "Fintech Operations",
    "support": "Customer Support",
}
TIER_LABELS = {
    "enterprise": "Enterprise Tier",
    "pro": "Professional Plan",
    "starter": "Starter Tier",
    "free": "Self-Serve & Free",
}
FILTER_BUCKET_LABELS = {
    "current": "Current (0-30 Days)",
    "days_31_60": "31-60 Days Overdue",
    "days_61_90": "61-90 Days Overdue",
    "days_90_plus": "90+ Days Delinquent",
}
GATEWAY_LABELS = {
    "stripe": "Stripe Connect",
    "plaid": "Plaid Instant ACH",
    "ach": "Federal Reserve ACH",
    "adyen": "Adyen Global Rail",
    "manual_journal": "Internal Clearing",
    "wire": "Fedwire RTGS",
}
OUTFLOW_LABELS = {
    "payout": "Vendor & Merchant Payouts",
    "fee": "Gateway & Processing Fees",
    "refund": "Customer Refunds & Disputes",
    "transfer": "Inter-Account Transfers",
    "adjustment": "Ledger Adjustments",
}
UNLABELLED_INFLOW = "Direct Payments"

# --- report constants ----------------------------------------------------------------------
RUNWAY_HEALTHY_DAYS = 180
RUNWAY_MODERATE_DAYS = 90
MARGIN_STRONG_PCT = 20.0
OVERDUE_LIMIT_PCT = 20.0
GATEWAY_OPTIMAL_PCT = 95.0
GATEWAY_HEALTHY_PCT = 93.0
ALERT_TITLES = {
    "runway": {
        "positive": "Healthy Runway Buffer",
        "warning": "Moderate Runway Watch",
        "danger": "Runway Warning",
    },
    "profitability": {
        "positive": "Strong Net Operating Margins",
        "info": "Positive Operating Cash",
        "warning": "Net Operating Deficit",
    },
    "ar_overdue": {
        "warning": "Elevated AR Delinquency",
        "positive": "Low Receivables Risk",
    },
    "gateway": {
        "positive": "Optimal Payment Routing",
        "warning": "Elevated Card Declines",
    },
}
OPEX_RATE = 0.38
AFTER_TAX_RATE = 0.85
FORWARD_QUARTER_RATES = {"q1": 1.08, "q2": 1.16}
BASELINE_HORIZON_DAYS = 91
BASELINE_CONE_RATE = 0.015
BASELINE_CONE_DAYS = 14.0
SCENARIOS = {
    # scenario: (quantile, label, fallback runway when cash falls)
    "worst_case": ("p10", "Worst-Case (P10 Conservative)", 180),
    "base_case": ("p50", "Base-Case (P50 Expected)", 240),
    "best_case": ("p90", "Best-Case (P90 Optimistic)", 365),
}
SCENARIO_RUNWAY_GROWING = 365
RUNWAY_UNLIMITED = 999
INFLOW_SHARE_OF_P50 = 0.6

AGING_BUCKETS = {
    # key: (bucket, risk tier, severity, status, provision %, recovery %)
    "current": ("0–30 Days (Current)", "Low Risk", "current", "Within Standard Terms", 1.5, 98.5),
    "days_31_60": ("31–60 Days", "Moderate", "moderate", "Automated Dunning Active", 5.0, 95.0),
    "days_61_90": ("61–90 Days", "Elevated Risk", "elevated", "Collector Assigned", 15.0, 85.0),
    "days_90_plus": (
        "90+ Days",
        "Critical Delinquency",
        "critical",
        "Demand Notice / Legal Hold",
        45.0,
        55.0,
    ),
}
HIGH_RISK_STAGES = {
    # risk tier: (90+ balance above, dunning stage, recommended action)
    "Critical": (500.0, "Legal Demand Notice", "Issue Formal Demand Letter & Freeze Credit"),
    "High": (250.0, "Final Notice Sent", "Direct Senior Collector Call & Escalate"),
    "Elevated": (0.0, "Escalated Dunning", "Send Urgent Statement with 5% Pay Discount"),
}
SEVERITY_STAGES = {
    # severity: (dunning stage, recommended action)
    "critical": ("Demand Notice", "Issue Legal Notice"),
    "elevated": ("Collector Assigned", "Direct Phone Call"),
    "moderate": ("Dunning Step 2", "Email Reminder"),
    "current": ("Current Terms", "Standard Invoice Delivery"),
}
CREDIT_LIMITS = {"enterprise": 5000.0, "pro": 2500.0}
CREDIT_LIMIT_DEFAULT = 1000.0
COLLECTIONS_TARGET_30D = 550000.0

RETRY_ACTIONS = {
    # action: (probability at least, hours until the retry)
    "retry_1h": (0.7, 1),
    "retry_24h": (0.4, 24),
    "retry_72h": (0.2, 72),
}
NO_RETRY_ACTION = "do_not_retry"
SCORING_HIGH_AMOUNT_USD = 250.0
TRAINING_HIGH_AMOUNT_QUANTILE = 0.9
