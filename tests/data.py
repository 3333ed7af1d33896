"""Triples of the tests."""

# The three-triple table.
THREE = [
    ("<triple_id_0001>", "<Chinese>", "<eat>", "<vegetables>"),
    ("<triple_id_0002>", "<Japanese>", "<eat>", "<fishes>"),
    ("<triple_id_0003>", "<Slovenian>", "<eat>", "<potatoes>"),
]

# The example table, as predicate: subject object, with ids in this order.
EXAMPLE_TSV = """
id1	japan	type	country
id2	slovenia	type	country
id3	koper	type	city
id4	ljubljana	type	city
id5	tokyo	type	city
id6	kyoto	type	city
id7	osaka	type	city
id8	up	type	university
id9	ul	type	university
id10	ijs	type	institute
id11	yj	type	corporation
id12	tu	type	university
id13	ku	type	university
id14	ou	type	university
id15	shou	type	person
id16	yoshio	type	person
id17	sakura	type	person
id18	luka	type	person
id19	jan	type	person
id20	nika	type	person
id57	marko	type	person
id21	japan	hasCapital	tokyo
id22	slovenia	hasCapital	ljubljana
id23	tokyo	isLocatedIn	japan
id24	kyoto	isLocatedIn	japan
id25	osaka	isLocatedIn	japan
id26	koper	isLocatedIn	slovenia
id27	ljubljana	isLocatedIn	slovenia
id28	up	isLocatedIn	koper
id29	ul	isLocatedIn	ljubljana
id30	ijs	isLocatedIn	ljubljana
id31	yj	isLocatedIn	tokyo
id32	ku	isLocatedIn	kyoto
id33	ou	isLocatedIn	osaka
id34	tu	isLocatedIn	tokyo
id35	shou	livesIn	tokyo
id36	yoshio	livesIn	tokyo
id37	sakura	livesIn	kyoto
id38	luka	livesIn	ljubljana
id39	jan	livesIn	koper
id40	nika	livesIn	ljubljana
id41	marko	livesIn	ljubljana
id42	shou	worksAt	yj
id43	shou	worksAt	ku
id44	yoshio	worksAt	yj
id45	sakura	worksAt	ku
id46	luka	worksAt	up
id47	luka	worksAt	ijs
id48	jan	worksAt	up
id49	nika	worksAt	ijs
id50	marko	worksAt	ijs
id51	shou	graduatedFrom	ou
id52	yoshio	graduatedFrom	tu
id53	sakura	graduatedFrom	ku
id54	luka	graduatedFrom	ul
id55	jan	graduatedFrom	up
id56	nika	graduatedFrom	ul
id58	shou	age	25
id59	yoshio	age	36
id60	sakura	age	27
id61	luka	age	38
id62	jan	age	45
id63	nika	age	22
id64	marko	age	30
""".strip()
EXAMPLE = [tuple(line.split("\t")) for line in EXAMPLE_TSV.splitlines()]
