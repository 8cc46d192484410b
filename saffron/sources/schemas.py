"""The eleven tables of the domain and the metadata of their contract."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    """Columns with their Spark types (the first is the primary key), and the row contract of one table."""

    columns: dict[str, str]
    required: tuple[str, ...] = ()
    parents: dict[str, str] = field(default_factory=dict)
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    positive: tuple[str, ...] = ()
    nonnegative: tuple[str, ...] = ()
    date_order: tuple[str, str] | None = None
    derived: tuple[str, str] | None = None  # column, SQL expression
    fill_unknown: str | None = None
    within_1_to_5: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        out = T.StructType()
        for name, kind in self.columns.items():
            out = out.add(name, kind)
        return out

    @property
    def key(self) -> str:
        return next(iter(self.columns))


# Names, types, allowed values and rules of the domain's tables.
CHANNELS = ("Dine-In", "Takeaway", "Mobile App", "Website", "Delivery Partner")
TABLES: dict[str, Table] = {
    "customers": Table(
        {"customer_id": "string", "customer_name": "string", "gender": "string", "age": "integer", "city": "string", "signup_date": "date", "customer_segment": "string", "preferred_channel": "string", "loyalty_points": "integer", "is_churned": "boolean", "last_order_date": "date"},
        required=("customer_id", "signup_date"),
        domains={"gender": ("Female", "Male", "Other"), "customer_segment": ("New", "Regular", "Loyal", "High Value", "Occasional"), "preferred_channel": CHANNELS},
        nonnegative=("age", "loyalty_points"), date_order=("signup_date", "last_order_date"), fill_unknown="city",
    ),
    "restaurants": Table(
        {"restaurant_id": "string", "restaurant_name": "string", "city": "string", "area": "string", "opening_date": "date", "seating_capacity": "integer", "location_type": "string", "is_active": "boolean"},
        required=("restaurant_id", "opening_date"),
        domains={"city": ("Karachi", "Lahore", "Islamabad", "Rawalpindi", "Faisalabad", "Multan"), "location_type": ("High Street", "Mall", "Commercial", "Residential")},
        nonnegative=("seating_capacity",),
    ),
    "menu_categories": Table(
        {"category_id": "string", "category_name": "string", "description": "string", "is_active": "boolean"},
        required=("category_id", "category_name"),
        domains={"category_name": ("Burgers", "Pizza", "Pakistani", "BBQ", "Beverages", "Desserts", "Chinese", "Fast Food", "Breakfast", "Salads", "Pasta", "Seafood", "Sandwiches", "Rice", "Coffee & Tea")},
    ),
    "menu_items": Table(
        {"menu_item_id": "string", "category_id": "string", "item_name": "string", "base_price": "double", "cost_price": "double", "preparation_time_min": "integer", "is_vegetarian": "boolean", "is_available": "boolean", "launch_date": "date"},
        required=("menu_item_id", "category_id", "launch_date"), parents={"category_id": "menu_categories"},
        positive=("base_price", "cost_price", "preparation_time_min"),
    ),
    "promotions": Table(
        {"promotion_id": "string", "promotion_name": "string", "promotion_type": "string", "discount_type": "string", "discount_value": "double", "start_date": "date", "end_date": "date", "minimum_order_value": "double", "channel": "string", "is_active": "boolean"},
        required=("promotion_id", "discount_type", "discount_value", "start_date", "end_date", "minimum_order_value"),
        domains={"promotion_type": ("Seasonal", "Acquisition", "Retention", "Flash Sale", "Bundle"), "discount_type": ("Percentage", "Fixed"), "channel": (*CHANNELS, "All")},
        nonnegative=("discount_value", "minimum_order_value"), date_order=("start_date", "end_date"),
    ),
    "orders": Table(
        {"order_id": "string", "customer_id": "string", "restaurant_id": "string", "promotion_id": "string", "order_datetime": "timestamp", "ordering_channel": "string", "order_status": "string", "subtotal": "double", "discount_amount": "double", "tax_amount": "double", "delivery_fee": "double", "final_amount": "double", "payment_method": "string"},
        required=("order_id", "customer_id", "restaurant_id", "order_datetime", "order_status", "subtotal", "discount_amount", "tax_amount", "delivery_fee", "final_amount"),
        parents={"customer_id": "customers", "restaurant_id": "restaurants", "promotion_id": "promotions"},
        domains={"ordering_channel": CHANNELS, "order_status": ("Completed", "Cancelled", "Refunded"), "payment_method": ("Cash", "Card", "Mobile Wallet", "Bank Transfer")},
        nonnegative=("subtotal", "discount_amount", "tax_amount", "delivery_fee", "final_amount"), fill_unknown="ordering_channel",
    ),
    "order_items": Table(
        {"order_item_id": "string", "order_id": "string", "menu_item_id": "string", "quantity": "integer", "unit_price": "double", "item_discount": "double", "line_total": "double", "special_request": "string"},
        required=("order_item_id", "order_id", "menu_item_id", "quantity", "unit_price", "item_discount"), parents={"order_id": "orders", "menu_item_id": "menu_items"},
        positive=("quantity", "unit_price"), nonnegative=("item_discount",), derived=("line_total", "quantity * unit_price - item_discount"),
    ),
    "pricing_history": Table(
        {"price_history_id": "string", "menu_item_id": "string", "restaurant_id": "string", "old_price": "double", "new_price": "double", "effective_from": "date", "effective_to": "date", "change_reason": "string"},
        required=("price_history_id", "menu_item_id", "restaurant_id", "old_price", "new_price", "effective_from"), parents={"menu_item_id": "menu_items", "restaurant_id": "restaurants"},
        domains={"change_reason": ("Inflation", "Supplier Cost", "Seasonal Adjustment", "Promotion End", "Menu Review")}, positive=("old_price", "new_price"), date_order=("effective_from", "effective_to"),
    ),
    "ratings": Table(
        {"rating_id": "string", "order_id": "string", "customer_id": "string", "restaurant_id": "string", "rating": "integer", "food_rating": "double", "service_rating": "double", "delivery_rating": "double", "review_text": "string", "rating_date": "date"},
        required=("rating_id", "order_id", "customer_id", "restaurant_id", "rating_date"), parents={"order_id": "orders", "customer_id": "customers", "restaurant_id": "restaurants"},
        within_1_to_5=("rating", "food_rating", "service_rating", "delivery_rating"),
    ),
    "inventory": Table(
        {"inventory_id": "string", "restaurant_id": "string", "menu_item_id": "string", "record_date": "date", "opening_stock": "integer", "stock_received": "integer", "stock_used": "integer", "closing_stock": "integer", "reorder_level": "integer", "stock_status": "string"},
        required=("inventory_id", "restaurant_id", "menu_item_id", "record_date", "opening_stock", "stock_received", "stock_used", "closing_stock", "reorder_level"),
        parents={"restaurant_id": "restaurants", "menu_item_id": "menu_items"}, domains={"stock_status": ("Low", "Normal")},
        nonnegative=("opening_stock", "stock_received", "stock_used", "closing_stock", "reorder_level"),
    ),
    "wastage": Table(
        {"wastage_id": "string", "restaurant_id": "string", "menu_item_id": "string", "wastage_date": "date", "quantity_wasted": "double", "unit_cost": "double", "wastage_cost": "double", "reason": "string"},
        required=("wastage_id", "restaurant_id", "menu_item_id", "wastage_date", "quantity_wasted", "unit_cost"), parents={"restaurant_id": "restaurants", "menu_item_id": "menu_items"},
        domains={"reason": ("Expired", "Overproduction", "Damaged", "Preparation Error", "Unsold")}, nonnegative=("quantity_wasted", "unit_cost"), derived=("wastage_cost", "quantity_wasted * unit_cost"),
    ),
}
#: Parents come before their children.
TABLE_ORDER = tuple(TABLES)
