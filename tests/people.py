"""Five groups of three source records, and a master file with four kinds of defect."""

import datetime

D = datetime.date
COLUMNS = "source_customer_id string, nik string, full_name string, phone string, email string, birth_date date"


def sources(spark):
    born = {1: D(1980, 1, 1), 2: D(1981, 2, 2), 3: D(1982, 3, 3), 4: D(1983, 4, 4)}
    rows = {"CRM": [], "LOS": [], "MOBILE": []}
    for g in (1, 2, 3, 4):
        nik, phone, email = f"32000000000000{g:02d}", f"0811000000{g:02d}", f"person{g}@example.com"
        rows["CRM"].append((f"CRM{g:03d}", nik, f"Person {g}", phone, email, born[g]))
        rows["LOS"].append((f"LOS{g:03d}", nik, f"PERSON {g}" if g == 2 else f"Person {g} B", phone, {3: "else3@example.com", 4: None}.get(g, email), born[g]))
        rows["MOBILE"].append((f"MOB{g:03d}", None if g == 2 else nik, f"Person {g}", phone, None if g == 1 else email, born[g]))
    rows["CRM"].append(("CRM005", "3200000000000051", "Alpha", "081100000051", "alpha@example.com", D(1990, 1, 1)))
    rows["LOS"].append(("LOS005", "3200000000000052", "Beta", "081100000052", "beta@example.com", D(1991, 1, 1)))
    rows["MOBILE"].append(("MOB005", "3200000000000053", "Beta", "081100000053", "gamma@example.com", D(1991, 1, 1)))
    return {s: spark.createDataFrame(r, COLUMNS) for s, r in rows.items()}


def master(spark):
    rows = []
    for i in range(1, 1001):
        nik = None if i == 10 else f"{3300000000000000 + (41 if i == 40 else i)}"
        rows.append((f"C{i:05d}", nik, f" Name {i} ", "ABC" if i == 20 else f"0812{i:08d}", f" User{i}@Example.com ", D(2999, 1, 1) if i == 30 else D(1970, 1, 1)))
    return spark.createDataFrame(rows, COLUMNS.replace("source_customer_id", "customer_id"))
