"""Table schemas, upload headers and labels.

The header texts and labels below are fixed values: they are part of the data
format, so they must be equal, letter by letter, to what uploads carry and what
reports show.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import types as T

# --- fixed values: labels shown in results --------------------------------
SHARED_SOURCE = "Общий источник"
TOTAL_LABEL = "Итого"
UNCATEGORISED = "Без категории"
NO_DATA = "Нет данных"

# --- fixed values: defaults of the product report -------------------------
DEFAULT_BASE_INCOME = 722556.74
DEFAULT_FUND_RATE = "0.20"
DEFAULT_AFTER_TAX_RATE = "0.94"
DEFAULT_HEADCOUNT = 2
DISPLAY_ZONE = "Europe/Moscow"

# --- fixed values: order upload header -> field ---------------------------
ORDER_HEADERS = {
    "Идентификатор": "id",
    "Номер": "number",
    "Имя контакта": "contact_name",
    "Фамилия контакта": "contact_surname",
    "Email контакта": "contact_email",
    "Ответственный": "responsible_person",
    "Содержимое": "content",
    "Статус": "status",
    "Общая сумма": "total_amount",
    "Оплаченная сумма": "paid_amount",
    "Дата создания": "creation_date",
    "Дата оплаты": "payment_date",
    "Валюта": "currency",
    "Теги": "tags",
    "Сумма скидки": "discount_amount",
    "Доход": "income",
    "Комиссия": "commission",
    "Идентификатор партнера": "partner_id",
    "Email партнера": "partner_email",
    "Комиссия партнера": "partner_commission",
    "Телефон контакта": "contact_phone",
    "Идентификатор контакта": "contact_id",
    "UTM Campaign": "utm_campaign",
    "UTM Content": "utm_content",
    "UTM Medium": "utm_medium",
    "UTM Source": "utm_source",
    "UTM Term": "utm_term",
    "Дата заказа в ГК": "gc_order_date",
}

# --- fixed values: contact upload header -> field -------------------------
CONTACT_HEADERS = {
    "Идентификатор": "id",
    "Полное имя": "full_name",
    "Имя": "first_name",
    "Отчество": "middle_name",
    "Фамилия": "last_name",
    "Email": "email",
    "Email адреса": "emails",
    "Телефон": "phone",
    "Телефоны": "phones",
    "Страна": "country",
    "Город": "city",
    "Регион": "region",
    "Теги": "tags",
    "Группы": "groups",
    "Дата создания": "creation_date",
    "День рождения": "birthday",
    "Последний раз онлайн": "last_online",
    "Последняя активность": "last_activity",
    "Сумма оплат": "total_paid",
    "Геймификация. Баллы": "gamification_score",
    "Баланс бонусов": "bonus_balance",
    "Партнер ID": "partner_id",
    "Первая utm_source метка": "first_utm_source",
    "Последняя utm_source метка": "last_utm_source",
    "tg_id": "tg_id",
}

# --- fixed values: cell texts that mean "missing" (the reader defaults of
# pandas, as its public documentation lists them) ---------------------------
MISSING_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- fixed values: column titles of the report tables ---------------------
PARTNER_TITLES = {
    "partner": "Партнер",
    "utm_source": "UTM Source",
    "order_count": "Количество регистраций",
    "total_income": "Доход",
}
PRODUCT_DAILY_TITLES = {
    "date": "Дата",
    "paid_orders": "Оплаты",
    "daily_sales": "Дневной доход",
    "cumulative_sales": "Накопительный доход",
    "cumulative_percentage": "% от прихода (накоп.)",
    "daily_percentage": "% от прихода (дневн.)",
}
PRODUCT_SUMMARY_TITLES = {
    "product": "Продукт",
    "paid_orders": "Оплаты",
    "total_income": "Доход",
    "average_check": "Средний чек",
}
PERIOD_TITLES = {
    "product": "Продукт",
    "paid_orders": "Оплаты",
    "total_income": "Доход",
}
CATEGORY_TITLES = {"category_name": "Категория", "total_revenue": "Доход"}
MONTHLY_TITLES = {
    "month": "Месяц",
    "product": "Продукт",
    "category": "Категория",
    "total_sales": "Сумма продаж",
    "paid_orders": "Оплаты",
}

ORDER_DATES = ("creation_date", "payment_date", "gc_order_date")
ORDER_MONEY = (
    "total_amount", "paid_amount", "discount_amount", "income", "commission",
    "partner_commission",
)
CONTACT_DATES = ("creation_date", "birthday", "last_online", "last_activity")
CONTACT_MONEY = ("total_paid", "gamification_score", "bonus_balance")


def _model(fields, dates, money) -> T.StructType:
    """Text columns, but for the named dates and amounts; ``id`` is the key."""
    kinds = {name: T.TimestampNTZType() for name in dates}
    kinds.update({name: T.DoubleType() for name in money})
    return T.StructType(
        [T.StructField(f, kinds.get(f, T.StringType()), f != "id") for f in fields]
    )


# ``recipient_last_name`` is stored but no upload carries it: new rows hold
# null there and updates keep what is stored.
_order_fields = list(ORDER_HEADERS.values())
_order_fields.insert(_order_fields.index("contact_email"), "recipient_last_name")
ORDERS_SCHEMA = _model(_order_fields, ORDER_DATES, ORDER_MONEY)
CONTACTS_SCHEMA = _model(CONTACT_HEADERS.values(), CONTACT_DATES, CONTACT_MONEY)

NAMED_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType(), False)]
)
LINKS_SCHEMA = T.StructType(
    [T.StructField("product_id", T.LongType()), T.StructField("category_id", T.LongType())]
)

# Tables that follow from the orders: where each id is stored since which version, and sums
# by day. ``creation_date`` is a day there; sums are exact.
_AMOUNT = T.DecimalType(38, 6)
KEYS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("stored_month", T.StringType()), T.StructField("at", T.LongType()),
])
PRODUCT_DAYS_SCHEMA = T.StructType([
    T.StructField("creation_date", T.DateType()), T.StructField("content", T.StringType()),
    T.StructField("total_orders", T.LongType()), T.StructField("paid_orders", T.LongType()),
    T.StructField("income", _AMOUNT), T.StructField("paid_income", _AMOUNT), T.StructField("latest", T.TimestampNTZType()),
])
SOURCE_DAYS_SCHEMA = T.StructType([
    T.StructField("creation_date", T.DateType()), T.StructField("utm_source", T.StringType()),
    T.StructField("total_orders", T.LongType()), T.StructField("income", _AMOUNT),
])


@dataclass(frozen=True)
class UploadSpec:
    """What one kind of upload must look like and where its rows go."""

    table: str
    headers: Mapping[str, str]
    dates: tuple[str, ...]
    money: tuple[str, ...]
    schema: T.StructType
    key: str = "id"


ORDER_UPLOAD = UploadSpec("orders", ORDER_HEADERS, ORDER_DATES, ORDER_MONEY, ORDERS_SCHEMA)
CONTACT_UPLOAD = UploadSpec(
    "contacts", CONTACT_HEADERS, CONTACT_DATES, CONTACT_MONEY, CONTACTS_SCHEMA
)
UPLOADS = {"orders": ORDER_UPLOAD, "contacts": CONTACT_UPLOAD}
