"""Texts labelled by hand, with pieces in order of type; none of the sentences stands in a table or among the training frames."""

N, M, P, I, S = "person_name", "email", "phone", "id_number", "street_address"
TEXTS = [
    ("Our accountant Maria Gonzalez lives at 12 Baker Street.", [(N, "Maria Gonzalez"), (S, "12 Baker Street")]),
    ("Yesterday Ahmed Khalil met Susan Porter.", [(N, "Ahmed Khalil"), (N, "Susan Porter")]),
    ("The applicant gave 078-05-1120 as a number.", [(I, "078-05-1120")]),
    ("After lunch Peter Hartmann showed Claire Dubois the new library.", [(N, "Peter Hartmann"), (N, "Claire Dubois")]),
    ("Rain fell all week, so Elena Petrova stayed at home.", [(N, "Elena Petrova")]),
    ("The bakery belongs to Antonio Ferrari and his sister.", [(N, "Antonio Ferrari")]),
    ("Dr. Hiroshi Tanaka will see patients on Thursdays.", [(N, "Hiroshi Tanaka")]),
    ("You may reach the caretaker on 555-867-5309 until noon.", [(P, "555-867-5309")]),
    ("Deliver the piano to 48 Marsh Lane, please.", [(S, "48 Marsh Lane")]),
    ("The flat at 7 Rosewood Avenue stood empty for a year.", [(S, "7 Rosewood Avenue")]),
    ("Write to j.kowalski@riverbank.org with any question.", [(M, "j.kowalski@riverbank.org")]),
    ("His address is bookings [at] oldmill [dot] net these days.", [(M, "bookings [at] oldmill [dot] net")]),
    ("Ring +33 1 42 68 53 00 for the keys.", [(P, "+33 1 42 68 53 00")]),
    ("Passport number XK 4471920 was reported stolen in Lisbon.", [(I, "XK 4471920")]),
    ("Mrs. Dorothy Blackwood and Mr. Samuel Okafor shared the prize.", [(N, "Dorothy Blackwood"), (N, "Samuel Okafor")]),
    ("Signed: Katarina Novak", [(N, "Katarina Novak")]),
    ("Julia Weber-Lang taught there before David Stone took over.", [(N, "Julia Weber-Lang"), (N, "David Stone")]),
    ("The will names Robert J. Whitfield as heir.", [(N, "Robert J. Whitfield")]),
    ("Witness: Omar Haddad, tel. +961 1 345678.", [(N, "Omar Haddad"), (P, "+961 1 345678")]),
    ("قابلت سميرة المنصوري في المكتبة صباح اليوم.", [(N, "سميرة المنصوري")]),
    ("تحدث الدكتور طارق النجدي عن المياه.", [(N, "طارق النجدي")]),
    ("Le docteur habite 15 rue de la Paix depuis mai.", [(S, "15 rue de la Paix")]),
    ("Thomas Eriksen repaired the boat; nobody paid Thomas Eriksen.", [(N, "Thomas Eriksen")]),
    # a name no dictionary has, once in telling surroundings and once in plain ones
    ("Contact: Zorvelda Quimbrasch, tel. 650-555-0123\nIn 2009 the note of Zorvelda Quimbrasch was read at length by the members.", [(N, "Zorvelda Quimbrasch"), (P, "650-555-0123")]),
    ("In the evening the members thanked Tivanor Wexley again. The report was signed by Dr. Tivanor Wexley, the chair.", [(N, "Tivanor Wexley")]),
    ("Some say that Brannick Ouldmere built the mill. Mr. Brannick Ouldmere denies it.", [(N, "Brannick Ouldmere")]),
    ("The Harbour Commission met the Council of Westport in Geneva.", []),
    ("Invoice 445-20-118 covers 3,400 bricks and 12 doors.", []),
    ("The Golden Lion Hotel has 48 rooms and a garden.", []),
    ("In May 2011 the Spring Festival drew 20 000 visitors.", []),
    ("Resolution A/61/295 was adopted by 144 votes to 4.", []),
    ("Mount Elbrus and Lake Baikal are on the list.", []),
    ("The Nobel Prize for Peace was not awarded in 1972.", []),
    ("Chapter 12, section 4: Rules of the House.", []),
]
