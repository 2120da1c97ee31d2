"""Column roles, schemas and names of the customer table."""

from __future__ import annotations

import re

from pyspark.sql import types as T

ID_COL = "CustomerID"
TARGET_COL = "Churn"
SENTIMENT_COL = "ticket_sentiment"

# The columns of the customer table, in file order.
CUSTOMER_COLUMNS = [
    ("CustomerID", T.StringType()),
    ("Gender", T.StringType()),
    ("SeniorCitizen", T.IntegerType()),
    ("Partner", T.StringType()),
    ("Dependents", T.StringType()),
    ("Tenure", T.IntegerType()),
    ("MonthlyCharges", T.DoubleType()),
    ("TotalCharges", T.DoubleType()),
    ("Contract", T.StringType()),
    ("PaymentMethod", T.StringType()),
    ("PaperlessBilling", T.StringType()),
    ("PhoneService", T.StringType()),
    ("MultipleLines", T.StringType()),
    ("InternetService", T.StringType()),
    ("OnlineSecurity", T.StringType()),
    ("OnlineBackup", T.StringType()),
    ("DeviceProtection", T.StringType()),
    ("TechSupport", T.StringType()),
    ("StreamingTV", T.StringType()),
    ("StreamingMovies", T.StringType()),
    ("SupportTickets", T.IntegerType()),
    ("LastLoginDays", T.IntegerType()),
    ("FeatureUsageCount", T.IntegerType()),
    ("CompanySize", T.StringType()),
    ("Industry", T.StringType()),
    ("Churn", T.StringType()),
]

CUSTOMER_SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in CUSTOMER_COLUMNS])

# Roles for cleaning.
CLEAN_NUMERIC = [
    "Tenure", "MonthlyCharges", "TotalCharges", "SupportTickets", "LastLoginDays", "FeatureUsageCount",
]
CLEAN_INTEGER = ["Tenure", "SeniorCitizen", "SupportTickets", "LastLoginDays", "FeatureUsageCount"]
CLEAN_CATEGORICAL = [
    "Gender", "SeniorCitizen", "Partner", "Dependents", "Contract", "PaymentMethod", "PaperlessBilling",
    "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup",
    "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies", "CompanySize", "Industry",
]
OUTLIER_EXEMPT = ["Tenure", "TotalCharges"]

# Roles for modelling.
MODEL_NUMERIC = CLEAN_NUMERIC + [SENTIMENT_COL]
MODEL_BINARY = ["SeniorCitizen", "Partner", "Dependents", "PaperlessBilling", "PhoneService"]
MODEL_CATEGORICAL = [
    "Gender", "Contract", "PaymentMethod", "MultipleLines", "InternetService", "OnlineSecurity",
    "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies",
    "CompanySize", "Industry",
]
SEED = 42
TEST_SHARE = 0.25

# Names of the three models, by their column prefix.
MODEL_NAMES = {"lr": "logistic_regression", "rf": "random_forest", "xgb": "xgboost"}

# Ordered categories and bin edges with their labels.
COMPANY_SIZES = ["Micro (<10)", "Small (10-50)", "Medium (51-250)", "Large (251-1000)", "Enterprise (1000+)"]
TENURE_EDGES = [0, 6, 12, 24, 36, 48, 60, 73]
TENURE_LABELS = ["0-6m", "6-12m", "12-24m", "24-36m", "36-48m", "48-60m", "60-72m"]
LOGIN_EDGES = [0, 3, 7, 14, 30, 61]
LOGIN_LABELS = [
    "0-3 days\n(Active)", "4-7 days\n(Recent)", "8-14 days\n(Moderate)",
    "15-30 days\n(Inactive)", "30+ days\n(At Risk)",
]

# Other spellings of the column names.
COLUMN_ALIASES = {
    "客户ID": "CustomerID",
    "customerid": "CustomerID",
    "customer_id": "CustomerID",
    "性别": "Gender",
    "是否为老年人": "SeniorCitizen",
    "是否有伴侣": "Partner",
    "是否有家属": "Dependents",
    "使用时长": "Tenure",
    "月费": "MonthlyCharges",
    "总费用": "TotalCharges",
    "合同类型": "Contract",
    "支付方式": "PaymentMethod",
    "电子账单": "PaperlessBilling",
    "电话服务": "PhoneService",
    "多线路": "MultipleLines",
    "互联网服务": "InternetService",
    "在线安全": "OnlineSecurity",
    "在线备份": "OnlineBackup",
    "设备保护": "DeviceProtection",
    "技术支持": "TechSupport",
    "流媒体电视": "StreamingTV",
    "流媒体电影": "StreamingMovies",
    "工单数": "SupportTickets",
    "最近登录": "LastLoginDays",
    "功能使用数": "FeatureUsageCount",
    "公司规模": "CompanySize",
    "行业": "Industry",
    "流失": "Churn",
    "是否流失": "Churn",
    "churn": "Churn",
}


def snake(name: str) -> str:
    """``MonthlyCharges`` -> ``monthly_charges``, ``CustomerID`` -> ``customer_id``."""
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()


SNAKE_NAMES = {name: snake(name) for name, _ in CUSTOMER_COLUMNS} | {SENTIMENT_COL: SENTIMENT_COL}
CAMEL_NAMES = {low: name for name, low in SNAKE_NAMES.items()}

# The store's users table holds neither the label nor MultipleLines; sentiment is kept when present.
NOT_STORED = {TARGET_COL, "MultipleLines"}
USER_COLUMNS = [SNAKE_NAMES[name] for name, _ in CUSTOMER_COLUMNS if name not in NOT_STORED] + [SENTIMENT_COL]

USERS_SCHEMA = T.StructType(
    [T.StructField(SNAKE_NAMES[name], kind) for name, kind in CUSTOMER_COLUMNS if name not in NOT_STORED]
    + [T.StructField(SENTIMENT_COL, T.DoubleType())]
)
PREDICTIONS_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("probability", T.DoubleType()),
    T.StructField("prediction", T.IntegerType()),
])


def present(wanted: list[str], columns: list[str]) -> list[str]:
    """The wanted columns that exist, in the wanted order."""
    have = set(columns)
    return [name for name in wanted if name in have]
