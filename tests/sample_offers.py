"""The reference's built-in 7-row sample table, as a test fixture.

Fixed values: the sample data exactly as the reference defines it (22 columns,
7 rows), plus an ``offer_id`` key (the supplier's letter).
"""

import pandas as pd

SAMPLE = {
    "supplier": ["Supplier A", "Supplier B", "Supplier C", "Supplier D", "Supplier E", "Supplier F", "Supplier G"],
    "price": [1000, 1175, 1080, 1120, 1055, 1205, 1095],
    "currency": ["USD", "EUR", "USD", "EUR", "USD", "EUR", "USD"],
    "discount": [50, 20, 35, 15, 25, 10, 30],
    "payment_terms": ["Net 30", "Net 60", "Net 45", "Net 30", "Net 60", "Net 45", "Net 30"],
    "quantity": [100, 180, 150, 170, 120, 160, 140],
    "min_order_quantity": [50, 90, 70, 85, 60, 80, 65],
    "lead_time_days": [30, 42, 29, 38, 33, 36, 40],
    "quality": [80, 86, 79, 83, 81, 82, 85],
    "technical": [90, 87, 86, 88, 85, 89, 91],
    "warranty_months": [24, 18, 20, 22, 18, 16, 24],
    "certifications": ["ISO9001,CE", "ISO14001", "ISO9001", "CE", "ISO9001,ISO14001", "CE", "ISO9001,CE"],
    "delivery_time_days": [35, 48, 33, 44, 39, 37, 41],
    "delivery_terms": ["FOB", "CIF", "FOB", "CIF", "FOB", "CIF", "FOB"],
    "shipping_cost": [100, 145, 95, 125, 110, 120, 115],
    "compliance": ["Yes", "No", "Yes", "Yes", "Yes", "No", "Yes"],
    "compliance_notes": ["All docs provided", "Missing certificate", "All docs provided", "All docs provided",
                         "All docs provided", "Missing docs", "All docs provided"],
    "country": ["USA", "Germany", "USA", "France", "USA", "Italy", "Spain"],
    "supplier_type": ["Manufacturer", "Distributor", "Manufacturer", "Distributor", "Manufacturer",
                      "Distributor", "Manufacturer"],
    "experience_years": [10, 6, 8, 7, 9, 5, 11],
    "score": [0.85, 0.79, 0.83, 0.81, 0.82, 0.77, 0.86],
    "remarks": ["Preferred", "", "Reliable", "", "Preferred", "", "Top rated"],
}


def sample_frame(spark):
    pdf = pd.DataFrame(SAMPLE)
    pdf.insert(0, "offer_id", [s[-1] for s in pdf["supplier"]])
    return spark.createDataFrame(pdf)
