"""Names, texts and boundaries that results must reproduce exactly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---- fixed values: texts a CSV reader takes as missing ------------------------------------------
NA_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# ---- fixed values: business roles and the column names that reveal them (fuzzy detection) -------
ROLE_ALIASES = {
    "customer_id": [
        "customerid", "customer_id", "clientid", "client_id", "accountid", "account_id", "customer", "name",
    ],
    "revenue": [
        "revenue", "monthlycharges", "monthly_charges", "totalcharges", "total_charges", "mrr", "arr", "sales",
        "amount",
    ],
    "tenure": ["tenure", "monthsactive", "months_active", "customerage", "customer_age", "subscriptionlength"],
    "churn": ["churn", "churned", "cancelled", "canceled", "attrition", "left", "exited"],
    "contract": ["contract", "contracttype", "contract_type", "plan", "subscription", "package"],
    "usage": ["usage", "productusage", "product_usage", "activity", "sessions", "logins", "engagement"],
    "tickets": ["tickets", "supporttickets", "support_tickets", "cases", "complaints", "issues"],
    "satisfaction": [
        "nps", "csat", "satisfaction", "customersatisfaction", "customer_satisfaction", "rating",
    ],
}

# ---- fixed values: the older role list (exact detection) ----------------------------------------
EXACT_ROLE_ALIASES = {
    "customer_id": ["customerid", "customer_id", "clientid", "client_id", "accountid", "account_id", "name"],
    "usage": ["usage", "productusage", "product_usage", "logins", "sessions", "activity"],
    "tickets": ["tickets", "supporttickets", "support_tickets", "cases", "complaints"],
    "nps": ["nps", "satisfaction", "customer_satisfaction", "csat"],
    "revenue": [
        "revenue", "monthlycharges", "monthly_charges", "totalcharges", "total_charges", "arr", "mrr",
    ],
    "tenure": ["tenure", "customer_age", "months_active", "subscription_length"],
    "churn": ["churn", "churned", "is_churned", "cancelled", "canceled"],
    "contract": ["contract", "contract_type", "plan", "subscription"],
}

# ---- fixed values: labels that mean "positive" --------------------------------------------------
POSITIVE_LABELS = ["yes", "true", "1", "churned", "cancelled", "canceled", "left", "exited"]
OLDER_POSITIVE_LABELS = ["yes", "true", "1", "churned"]

# ---- fixed values: ordered categories -----------------------------------------------------------
CONTRACT_ORDER = ["Month-to-month", "One year", "Two year"]
TENURE_BANDS = ["0–12 months", "13–24 months", "25–48 months", "49+ months"]
TIER_ORDER = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
STATUS_ORDER = ["Retained", "Churned"]
RENEWAL_STATUSES = ["Likely", "At Risk", "Unknown"]

# ---- fixed values: health and renewal texts -----------------------------------------------------
HEALTH_TEXTS = {
    "Healthy": "Strong engagement detected. Consider upsell opportunities.",
    "At Risk": "Schedule a customer success review.",
    "Critical": "Immediate intervention required.",
}
RENEWAL_TEXTS = {
    "High": "Immediate intervention required. Schedule an executive review.",
    "Medium": "Schedule a customer success check-in.",
    "Low": "Customer is healthy. Consider upsell opportunities.",
}

# ---- fixed values: retention actions ------------------------------------------------------------
TIER_ACTIONS = {
    "LOW": "Maintain standard engagement cadence.",
    "MEDIUM": "Monitor account and schedule proactive check-in.",
    "HIGH": "Add customer to proactive retention queue.",
    "CRITICAL": "Immediate CSM retention outreach recommended.",
}
CONTRACT_ACTION = "Explore annual contract conversion or loyalty incentive."
SUPPORT_ACTION = "Review support needs and consider proactive technical assistance."
SECURITY_ACTION = "Discuss security-service adoption where relevant to the customer."
PAYMENT_ACTION = "Review payment experience and consider automatic-payment options."
TENURE_ACTION = "Prioritize early-lifecycle engagement and onboarding follow-up."
MAX_ACTIONS = 5

# ---- fixed values: profile fields, with their labels --------------------------------------------
SUMMARY_FIELDS = {
    "Customer ID": "customerID",
    "Tenure": "tenure",
    "Contract": "Contract",
    "Monthly Charges": "MonthlyCharges",
    "Total Charges": "TotalCharges",
    "Internet Service": "InternetService",
    "Payment Method": "PaymentMethod",
    "Tech Support": "TechSupport",
    "Online Security": "OnlineSecurity",
    "Actual Churn": "Churn",
}
COMPARISON_FIELDS = {
    "Customer ID": "customerID",
    "Tenure": "tenure",
    "Contract": "Contract",
    "Monthly Charges": "MonthlyCharges",
    "Total Charges": "TotalCharges",
    "Internet Service": "InternetService",
    "Payment Method": "PaymentMethod",
    "Tech Support": "TechSupport",
    "Online Security": "OnlineSecurity",
    "Paperless Billing": "PaperlessBilling",
    "Actual Churn": "Churn",
}
MISSING_TEXT = "Not available"

# ---- fixed values: columns ----------------------------------------------------------------------
DERIVED_COLUMNS = ["customerID", "Churn", "Churn Binary", "Tenure Band"]
ANALYTICS_COLUMNS = [
    "customerID", "Churn", "Contract", "PaymentMethod", "InternetService", "tenure", "MonthlyCharges",
]
REPORT_COLUMNS = ["customerID", "Churn", "tenure", "MonthlyCharges"]
NUMERIC_FEATURES = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"]
CATEGORICAL_FEATURES = [
    "gender", "Partner", "Dependents", "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity",
    "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies", "Contract",
    "PaperlessBilling", "PaymentMethod",
]

# ---- fixed values: the published model report ---------------------------------------------------
PUBLISHED_METRICS = {
    "Champion model": "Gradient Boosting",
    "Tuned CV ROC-AUC": "0.8505",
    "Intervention threshold": "0.33",
    "Recall at optimized threshold": "0.7258",
    "F1 at optimized threshold": "0.6411",
    "Mean calibration gap": "0.0182",
}

CUSTOMER_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("usage", T.DoubleType()),
    T.StructField("tickets", T.IntegerType()),
    T.StructField("nps", T.IntegerType()),
    T.StructField("renewal_status", T.StringType()),
])
STORED_CUSTOMER_SCHEMA = T.StructType([T.StructField("id", T.LongType()), *CUSTOMER_SCHEMA.fields])

ACCOUNT_SCHEMA = T.StructType([
    T.StructField("customerID", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("SeniorCitizen", T.LongType()),
    T.StructField("Partner", T.StringType()),
    T.StructField("Dependents", T.StringType()),
    T.StructField("tenure", T.LongType()),
    T.StructField("PhoneService", T.StringType()),
    T.StructField("MultipleLines", T.StringType()),
    T.StructField("InternetService", T.StringType()),
    T.StructField("OnlineSecurity", T.StringType()),
    T.StructField("OnlineBackup", T.StringType()),
    T.StructField("DeviceProtection", T.StringType()),
    T.StructField("TechSupport", T.StringType()),
    T.StructField("StreamingTV", T.StringType()),
    T.StructField("StreamingMovies", T.StringType()),
    T.StructField("Contract", T.StringType()),
    T.StructField("PaperlessBilling", T.StringType()),
    T.StructField("PaymentMethod", T.StringType()),
    T.StructField("MonthlyCharges", T.DoubleType()),
    T.StructField("TotalCharges", T.StringType()),
    T.StructField("Churn", T.StringType()),
])


@dataclass(frozen=True)
class RiskPolicy:
    """Tier boundaries: LOW < low <= MEDIUM < intervention <= HIGH < critical <= CRITICAL."""

    low: float = 0.15
    intervention: float = 0.33
    critical: float = 0.60


DEFAULT_POLICY = RiskPolicy()

# ---- fixed values: hyper-parameter search spaces, by the classifier's own parameter names -------
LOGISTIC_SPACE = {"C": [0.01, 0.05, 0.1, 0.5, 1, 2, 5, 10]}
FOREST_SPACE = {
    "n_estimators": [200, 300, 500, 700],
    "max_depth": [None, 5, 8, 12, 16],
    "min_samples_leaf": [1, 2, 4, 8],
    "max_features": ["sqrt", "log2", None],
}
BOOSTING_SPACE = {
    "n_estimators": [100, 150, 200, 300],
    "learning_rate": [0.01, 0.03, 0.05, 0.1],
    "max_depth": [2, 3, 4, 5],
    "min_samples_leaf": [1, 2, 4, 8],
    "subsample": [0.7, 0.85, 1.0],
}
LOGISTIC, FOREST, BOOSTING = "Logistic Regression", "Random Forest", "Gradient Boosting"
SEED = 42
