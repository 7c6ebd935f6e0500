"""Pages in wording of their own; ``-`` marks the lines around a page's own text. README says how many lines were right before rules were widened for them."""

PAGES = [
    """
-Front Page | Local | Sport | Weather | Obituaries
-We value your privacy. Our site uses trackers to tailor what you see. 
-Fine by me
Harbour ferry to run late on Fridays from June
The council voted on Tuesday, by a margin of seven to four, to extend the last crossing until half past eleven.
Supporters, among them the chamber of trade, said restaurants on the east side lose guests who must leave early.

The cost is put at forty thousand pounds a year, most of which will come from parking charges.
-Readers' favourites
-Six walks for a wet afternoon
-Why the old mill was saved
-Bakery wins county prize again
-Spread the word: Facebook · WhatsApp · Mail
-© Harbour Courier 2023 – Made on the coast
""",
    """
-Skip navigation
-Patients
-Clinicians
-Vacancies
-Find us

Vaccination for over-sixties starts early

Appointments can be booked from the first of September, two weeks sooner than last year, because supplies arrived ahead of plan.

Who should come
• people aged sixty and above
• pregnant women in any trimester
• carers of someone at risk

Side effects are mild, usually a sore arm, and pass within two days.

-Was this page useful? Yes | No
-You might like
-Sleep clinics open in three towns
-Waiting times fall in the north
-Charity number 1180443 | Registered office: Elm House, Leyton
""",
    """
-Home > Research > Blog

-Posted by the editorial team on 4 March, 10:15
Counting seals from the air
Drones have replaced boats in the annual survey of grey seals, and the counts are more exact for it.
For the first time, pups hidden between boulders, which observers in boats could not see, were recorded too.
-Enjoying this? Get our monthly letter in your inbox
The team flew at sixty metres, a height at which, tests had shown, the animals do not stir.
Year | Adults | Pups
2021 | 412 | 133
2022 | 438 | 151
Correction: an earlier version gave the height as sixteen metres.
-4 replies to “Counting seals from the air”
-Follow the institute on Mastodon
-Accessibility · Freedom of information · Cookie settings
""",
    """
Road bridge shuts for nine days
-Share this: X / LinkedIn / Copy URL
Engineers will replace both expansion joints, and traffic is sent around by the ring road, the county said.
Buses on routes 4, 9 and 12 turn at the station while work lasts.
-Don't miss: Tunnel toll to rise in the spring
The last closure, in 2009, took three weeks.
-Sign in to save this article
-More from Transport
-Night trains return to the valley line
-Cycle path opens along the canal
-New timetable leaves villages out
-This website stores data on your device so it can remember you. Settings
-Terms | Privacy | Contact
""",
    """
-MENU  Shop  Events  Membership  Visit

Spring lecture looks at lost villages

Dr Howells will show maps of eleven settlements that were given up after the plague, and explain how they were found.
Doors open at six; seats are free, but members have the first two rows.

How to get here
The hall is ten minutes on foot from the station, and there is parking behind the church.

-Become a member today and support our work
-Recent posts
-A bell comes home
-Notes from the summer dig
-Museum hours in winter
-All content © Vale History Society. Photographs may not be reused.
-Back to top
""",
]

#: Written after the operator had been changed for the others; it was then changed once more for what it missed here.
LATER = [
    """
-Log in
-Basket (0)
-Trade enquiries
-By continuing you agree that we may place trackers on your computer.
-Understood

Glasshouse tomatoes need less heat than thought
Growers who let the night temperature fall to fourteen degrees lost no yield, a trial over two winters found.
The saving, at last year's gas price, came to nine per cent of all costs.

1. Lower the set point by one degree a week
2. Watch the humidity, which rises as the air cools
3. Vent early in the morning

Further trials, with peppers and cucumbers, begin in October.

-Newsletter: growing tips every Thursday
-Other readers enjoyed
-Peat-free compost put to the test
-Which fleece lasts longest
-Company no. 0441882. VAT 110 2231 07.
""",
    """
-A to Z | Opening hours | Languages

-You are here: Start > Housing > Notices
Tower block to be re-clad by autumn
The panels on the north face, which failed an inspection in March, will be replaced first.
Tenants may stay in their flats, but balconies will be closed for up to six weeks.
-Print | Larger text | Listen

What it costs
The borough pays for the work; rents and service charges do not change.

-Rate this information
-Did you find what you were looking for?
-Popular pages
-Report a repair
-Bin collection days
-© Borough of Eastmere. Crown copyright applies to maps.
""",
]


def cases(pages=PAGES):
    """(lines, numbers of the lines around the text) of each page."""
    for page in pages:
        marked = page.strip("\n").split("\n")
        yield [x.removeprefix("-") for x in marked], {i for i, x in enumerate(marked) if x.startswith("-")}