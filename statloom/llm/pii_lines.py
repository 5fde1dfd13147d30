"""A small labelled table, written by hand: lines in which {kind|value} marks a value. Names, hosts and numbers are invented."""

from __future__ import annotations

import re

#: Fixed values.
LINES = """
please write to {email|jo at mail dot org} please
write to {email|jo at mail dot org}
you can reach me: {email|anna at example dot com}, thanks
{email|jo at mail dot org}
send it to {email|t.meyer at uni-berlin dot de} before noon
email {email|jo at mail.org} if you are late
my address is {email|paul (at) north dot net} now
reach {email|carla[at]site[dot]com} or me
contact: {email|bob(at)mail(dot)com}
{email|bob(at)mail(dot)com} knows more
ask {email|luis {at} correo {dot} es} about it
mail {email|sam at corp [dot] net} today
mail me: {email|kim@mail[.]org}
the list is {email|team-x at lists dot host dot org} since May
try {email|peter dot pan at never dot land} first
questions go to {email|help <at> desk <dot> io}
his e-mail: {email|m_lang (at) firma.de}.
drop a line to {email|eve [at] box.net}!
contact {email|rosa at flor dot com dot br} for tickets
write {email|info at haus dot at} or call
we met at home. the dot on the map is ours
look at the dot in the middle
he was at work at nine dot
she works at the mall dot com boom or not
read more at example.com today
see you at noon. dot your letters
the talk is at station dot seven
at best a dot org chart remains
the file lies at host.name.tld in a folder
meet me at 10.30 at the door
he looked at mail dot after dot
server {ip|10[.]0[.]0[.]7} is down
ping {ip|192 . 168 . 1 . 20} again
from {ip|172(.)16(.)4(.)9} came nothing
host {ip|10 dot 1 dot 2 dot 3} answers
block {ip|203[.]0[.]113[.]50} and {ip|198[.]51[.]100[.]4}
the address {ip|8 dot 8 dot 8 dot 8} is public
version 1 . 2 . 3 of the tool
scores were 10 . 20 . 30 in all
section 4 dot 2 dot 1 explains it
card {card|4111.1111.1111.1111} was charged
pay with {card|5500/0000/0000/0004} please
visa {card|4012_8888_8888_1881} expires soon
credit card number {card|3714 . 4963 . 5398 . 431}
invoice 4111.2222.3333.4444 is open
order 2024 1234 5678 90 shipped
order 1234 5678 9012 arrived
parcel 0034 0433 8306 1234 is late
isbn 978 3 16 148410 0 is out
serial 4432 9981 0032 is broken
account 100 200 300 400 is closed
ticket 555 0142 8873 is done
lot 12-345-678-90 sold
on 2021-05-14 12:30 we left
from 1939 1945 to 1950 1960
page 112 113 114 115 of it
rows 100 200 300 400 500 were dropped
call {phone|(202) 555-0143} now
tel {phone|202-555-0187} after six
phone {phone|202.555.0156} or write
my number is {phone|555 013 4477}
fax: {phone|030 5550 1234}
mobile {phone|0171 555 01234} at night
ring {phone|(030) 555-0199-12} for the desk
text me {phone|415-555-0110}
the office ({phone|212 555 0178}) is closed
dial {phone|020 7946 0958} in London
you may call {phone|(617) 555-0122} or {phone|(617) 555-0123}
whatsapp {phone|0044 20 7946 0011} works
room 415-555 is on floor 3
bus 202 and 555 run daily
build 2024.1234.5678 passed
between 300 and 400 people came
they sold 1 200 300 units in 2020
the score was 21-19-25-17 in the end
coordinates 52 31 12 13 24 18 on the map
part no 555-0143-77 fits
"""


#: A value runs to the next brace that a space, a sign or the line's end follows; braces inside it stand around a word.
MARK = re.compile(r"\{(email|ip|card|phone)\|((?:[^{}]|\{(?:at|dot)\})*)\}")


def labelled(lines: str = LINES) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of each line: a word, between white space, has the label of the value it shares characters with."""
    out = []
    for line in lines.strip().splitlines():
        text, spans, done = "", [], 0
        for m in MARK.finditer(line):
            text += line[done : m.start()]
            spans.append((len(text), len(text) + len(m[2]), m[1]))
            text, done = text + m[2], m.end()
        text += line[done:]
        words = list(re.finditer(r"\S+", text))
        out.append(([w[0] for w in words], [next((k for a, b, k in spans if w.start() < b and a < w.end()), "o") for w in words]))
    return out
