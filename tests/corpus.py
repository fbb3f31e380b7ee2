"""A small record of an institution in our own words, for several test modules."""

SCHEMA = "document_id string, filename string, pages array<string>, text string"
DOCS = [
    ("D1", "a.txt", ["Minutes.\n\nThe Academic Council of Green Valley College met on 5 March 2024. The meeting was chaired by Dr. Asha Rao. Prof. Ben Cole and Dr. Lina Das attended. Prof. Ben Cole proposed the introduction of a data science minor. The Academic Council approved the introduction of a data science minor on 5 March 2024 because industry demand is rising. The Registrar Department was tasked with publishing the syllabus to implement the decision by 30 April 2024.", "The Academic Council deferred the new hostel plan because funds were short."], None),
    ("D2", "b.txt", None, "The Board of Governors met on April 2, 2024. The Board of Governors approved the data science minor on April 2, 2024 because the budget allows it."),
    ("D3", "c.txt", None, "The Finance Committee met on 2024-03-20. The Finance Committee rejected the purchase of a bus because costs exceed the budget."),
    ("D4", "d.txt", None, None),
    ("D5", "e.txt", None, "The Library Committee met on 7 May 2024. Dr. Lina Das attended."),
]
