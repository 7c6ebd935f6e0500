"""Sentences with names that no list of the operator holds (given or family), and the name. README says how many were right before shapes were widened for them."""

NAMES = """Rohan Deshpande said the plan was sound.|Rohan Deshpande
The minutes were signed by Siobhan Walsh on Monday.|Siobhan Walsh
Please contact Kwame Mensah for details.|Kwame Mensah
Ngozi Okafor joined the board in May.|Ngozi Okafor
We spoke with Thandiwe Nkosi about the outlook.|Thandiwe Nkosi
The letter from Bjarne Lindqvist was filed.|Bjarne Lindqvist
Mr. Okonkwo-Reyes, Tendai, abstained.|Okonkwo-Reyes, Tendai
Yelena Petrovna Sokolova, chief accountant, resigned.|Yelena Petrovna Sokolova
According to Hyun-woo Park, demand fell.|Hyun-woo Park
Shareholder Wojciech Zieliński of Leeds objected.|Wojciech Zieliński
Selon Aurélie Bouchard, la hausse est faible.|Aurélie Bouchard
Laut Gerlinde Hofstetter bleibt es dabei.|Gerlinde Hofstetter
Según Iñaki Echeverría, no hay cambios.|Iñaki Echeverría
Frau Mechthild Krämer verlässt den Vorstand.|Mechthild Krämer
Mme Solène Thibault a démissionné.|Solène Thibault
The chair, Dr. Oluwaseun Adeyemi, thanked members.|Oluwaseun Adeyemi
"We agree," Maeve O'Sullivan told reporters.|Maeve O'Sullivan
Between Anil Kapoor and the bank a dispute arose.|Anil Kapoor
The payment was approved by Rhys Llewellyn.|Rhys Llewellyn
Contact: Zsófia Nagy, +36 1 555 0199|Zsófia Nagy
The late Dafydd Pritchard, who founded the firm, was honoured.|Dafydd Pritchard
Takeshi Yamamoto, aged 52, leads the unit.|Takeshi Yamamoto
Analyst Chidinma Eze expects growth.|Chidinma Eze
/s/ Ragnhild Solberg|Ragnhild Solberg
Name: Xiaoming Zhang|Xiaoming Zhang
Geschäftsführer Ottokar Brandstätter erklärte dies.|Ottokar Brandstätter
The witness Folake Adebayo gave evidence.|Folake Adebayo
R. K. Narasimhan abstained.|R. K. Narasimhan
La directora Itziar Goikoetxea dimitió.|Itziar Goikoetxea
The employee, Mbali Dlamini, was paid.|Mbali Dlamini"""

#: Capitalised words beside the same words of context that name nobody.
NOBODY = """Vereldale Bulletin said so.
The Bank of Northport told us.
We met with Harbour Holdings plc in May.
He moved from North Weaver to Port Elgin.
Payment by Lanargate Bancorp was late.
Results by Business Segment were good.
Contact Investor Relations today.
The Dorvley Fund joined.
Chief Executive Officer said.
Notice Of Quarterly Data Series And Regional Rights Issue"""
