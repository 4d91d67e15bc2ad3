"""Sentences with personal data for training: carriers in five languages, made values, and look-alikes.

A carrier is a sentence with slots. Its values are made by rule from short lists of public words, so
the network sees shapes and neighbours rather than a fixed set of names. Every seventh carrier is
held out: it is never trained on, and recall is measured on it.
"""

from __future__ import annotations

import random
import re
import string

#: Every which carrier of a list is held out.
HELD = 7

# Common given names, surnames, towns and streets of several languages.
GIVEN = """James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Daniel Karen Lucy
Emma Oliver Amelia Jack Grace Harry Sophie George Alice Noah Liam Olivia Ethan Aisha Omar Fatima Priya Rahul Anjali Yusuf Leila Kofi Amara Chen Wei Mei Hiroshi Yuki
Hans Anna Peter Ursula Klaus Monika Jürgen Sabine Stefan Petra Wolfgang Heike Lukas Lena Felix Jonas Lea Matthias Katrin Uwe Jan Greta Sven Ingrid Björn Astrid
Jean Marie Pierre Isabelle Michel Nathalie François Sylvie Luc Camille Antoine Chloé Étienne Margaux Benoît Hélène Mathieu Aurélie Zoé Théo
José María Antonio Carmen Manuel Ana Javier Lucía Carlos Elena Miguel Paula Sergio Marta Raúl Pilar Iñigo Begoña Diego Sofía
Ivan Olga Dmitri Natalia Marek Agnieszka Pavel Zuzana Giulia Marco Lorenzo Chiara João Inês Tiago Eszter""".split()
SURNAMES = """Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson White Harris Clark Lewis Walker Young King Wright Baker Hill Carter
Mitchell Turner Parker Evans Edwards Collins Stewart Morris Murphy Cook Bell Ward Brooks Gray Hughes Foster O'Brien O'Connor MacDonald McCarthy Fitzgerald Patel Sharma Singh Khan Hussain
Okafor Mensah Nguyen Tanaka Sato Kim Park Müller Schmidt Schneider Fischer Meyer Weber Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Schröder Neumann
Zimmermann Braun Krüger Hartmann Lange Köhler Maier Huber Dubois Durand Leroy Moreau Laurent Lefèvre Michaud Fournier Girard Bonnet Dupont Lambert Rousseau Blanc Garnier
García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Martín Jiménez Ruiz Hernández Díaz Muñoz Álvarez Romero Navarro Torres Ortega Novak Kowalski Nowak
Horváth Rossi Bianchi Ferrari Romano Silva Santos Oliveira Costa Ivanov Petrov Sokolov Johansson Lindqvist Hansen Nielsen Virtanen Korhonen Jansen Bakker Peeters Popescu Yılmaz""".split()
HAN_SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文蔺仝"
HAN_GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀兰霞平刚桂英华玉萍红梅建国文辉力健世广志义兴良海山仁波宁贵福生龙元全胜学祥才发武新利清飞彬富顺信子远岫暮迟晨雨欣怡梓涵浩然思琪俊宇轩"
TOWNS = """London Manchester Leeds Bristol Oxford Cambridge Edinburgh Dublin Boston Chicago Denver Seattle Portland Austin Springfield Madison Riverside Toronto Sydney Berlin München
Hamburg Köln Frankfurt Stuttgart Leipzig Dresden Bremen Freiburg Paris Lyon Marseille Toulouse Nantes Bordeaux Lille Rennes Madrid Barcelona Valencia Sevilla Bilbao Málaga Zaragoza Granada""".split()
EN_STREETS = "Baker Oak Maple Church High Station Park Victoria Mill King Queen Elm Cedar Washington Lake Hill Main Bridge Chapel Orchard Garden North River Sunset Pine".split()
EN_KINDS = "Street St. St Road Rd Rd. Avenue Ave Ave. Lane Ln Drive Dr. Way Court Close Crescent Place Terrace Boulevard Blvd Square".split()
DE_STREETS = "Haupt Bahnhof Garten Schul Berg Linden Goethe Schiller Kirch Wald Ring Mozart Rosen Feld Brunnen Kastanien Ahorn Mühlen Dorf Post".split()
FR_STREETS = "Victor Hugo|Pasteur|Lilas|Gare|République|Général Leclerc|Moulin|Écoles|Jean Jaurès|Paix|Église|Roses|Gambetta|Marronniers|Fontaine".split("|")
ES_STREETS = "Mayor|Real|Alcalá|Constitución|Sol|Cervantes|Goya|San Juan|Libertad|Prado|Olmo|Fuente|Norte|Andalucía|Rosales".split("|")
HAN_TOWNS = "北京市 上海市 广州市 深圳市 杭州市 南京市 成都市 武汉市 西安市 苏州市 青岛市 长沙市".split()
HAN_AREAS = "朝阳区 海淀区 浦东新区 天河区 西湖区 鼓楼区 武侯区 江岸区 雁塔区 市南区".split()
HAN_STREETS = "人民路 中山路 解放路 建国路 长江路 文化路 和平街 新华街 光明路 学院路 湖滨路 青云路".split()
DOMAINS = "mail example post company uni office web shop news cloud team studio lab health travel".split()
ENDINGS = ".com .org .net .edu .io .de .fr .es .cn .co.uk .gov .info .ac.uk .com.cn .example .test .invalid .eu".split()

# Names of things that look like those of persons, numbers that look like personal ones.
THINGS = """Harrow Index|Supreme Court|Golden Gate Bridge|New York Times|Lake Michigan|Black Forest|Red Cross|Open Source|Machine Learning|Project Apollo|Central Park|North Sea|Mount Everest|World Bank
European Union|Silicon Valley|General Assembly|Royal Society|Tower Bridge|Windows Server|Visual Studio|Data Lake|Blue Whale|Great Wall|Nobel Prize|Civil War|Cold Brew|Quality Report|Annual Review|Release Notes
User Guide|Green Valley School|Oak Street Bakery|Trinity College|Deutsche Bahn|Deutscher Bundestag|Neue Zürcher Zeitung|Schwarzer Tee|Grüner Punkt|Rotes Kreuz|Alte Pinakothek|Tour Eiffel|Notre Dame|Code Civil
Grand Palais|Le Monde|Mont Blanc|Real Madrid|Casa Blanca|Banco Central|Museo del Prado|Semana Santa|Plaza Mayor|Nueva Zelanda|San Francisco|Costa Rica|Los Angeles|Buenos Aires|Monday Morning|Section Three
Acme Corporation|Blue Ridge Foods Ltd|Kestrel Shipping Inc|Northern Rail|Summer School|Team Alpha|Chapter Seven|Table Four|Winter Olympics|Premier League|Data Protection Act|Neural Network|Gradient Descent
Random Forest|Bayes Theorem|Ohm Law|Python Library|Apache License|Common Crawl|Hash Table|Binary Tree|Sourdough Bread|Olive Oil|Penalty Kick|Free Throw""".replace("\n", "|").split("|")

_EN = {
    "name": [
        "{name} joined the call late.", "I spoke with {name} yesterday.", "We met {name} and {name} at the fair.", "{name} said that it was fine.", "Written by {name}", "by {name}, staff writer", "Best regards, {name}", "Dear {name}, thank you for the note.",
        "The director, {name}, told us more.", "Photo: {name}", "Dr. {name} examined the patient.", "My colleague {name} will answer.", "The book by {name} sold well.", "Ask {name} about the rota.", "{name}'s report is overdue.", "He was replaced by {name} in May.",
        "Mr. {name} and Mrs. {name} moved away.", "Author: {name}", "Contact person: {name}", "Signed: {name}", "According to {name}, the numbers are wrong.", "{name} (captain) scored twice.", "The judge asked {name} to sit down.", "Thanks to {name} for the help.", "from {name} to {name}", "Attendees: {name}, {name}, {name}", "{name} has approved the change.", "Reviewed by {name}.", "cc {name}", "Patient {name} was seen on Monday.", "{name} wrote the minutes.", "- {name}: I agree with that.", "Interview with {name}", "Hi {name}, how are you?",
        "She is the daughter of {name}.", "Prof. {name} teaches law.", "The winner is {name}.", "assigned to {name} on 3 May", "{name} lives there with her sister.", "We asked {name}, but nobody answered.", "Sincerely yours, {name}",
    ],
    "email": ["Email me at {email} please.", "I can be reached at {email}.", "Send it to {email}.", "<{email}>", "E-mail: {email}", "Questions? {email}", "From: {email}", "cc: {email}, {email}", "My address is {email}, write any time.", "mailto:{email}", "{email} bounced again.", "Forward the file to {email} or {email}.", "login {email} was locked", "Contact {email} for access.", "reply to {email} by Friday", "Subscribe with {email} today."],
    "phone": ["Call {phone} after nine.", "Phone: {phone}", "My number is {phone}.", "Tel. {phone}", "You can reach me on {phone}.", "Fax {phone}", "Mobile {phone}, evenings only.", "Ring {phone} for the desk.", "text {phone} to confirm", "The hotline is {phone}.", "Dial {phone} and wait.", "(t) {phone}", "WhatsApp {phone}", "call us at {phone} or {phone}", "The desk answers on {phone} only.", "She left {phone} as a contact."],
    "ssn": ["SSN {ssn}", "SSN: {ssn}", "Her social security number is {ssn}.", "Social Security No. {ssn}", "ssn={ssn}", "The SSN on file, {ssn}, was wrong.", "social security number: {ssn}", "tax form with SSN {ssn} attached", "Enter your SSN ({ssn}) here.", "His SSN is {ssn}."],
    "id_number": ["Passport no. {id_number}", "Passport number: {id_number}", "Her passport {id_number} has expired.", "National ID {id_number}", "identity card {id_number}", "ID card no. {id_number}", "National insurance number {id_number}", "Driver's licence {id_number} was shown.", "holder of passport {id_number}", "His identity number is {id_number}."],
    "credit_card": ["Card number {credit_card}", "Paid with card {credit_card}.", "My Visa is {credit_card}.", "Mastercard {credit_card} exp. 09/27", "Charge it to {credit_card}.", "credit card: {credit_card}", "The card {credit_card} was declined.", "Amex {credit_card}", "please use {credit_card} for the deposit", "Card no. {credit_card}, thanks."],
    "ipv4": ["Client {ipv4} timed out.", "The server at {ipv4} is down.", "Login from {ipv4}", "IP: {ipv4}", "ping {ipv4}", "ssh root@{ipv4}", "Blocked {ipv4} after three attempts.", "http://{ipv4}:8080/index", "The request came from {ipv4}.", "address {ipv4} was banned", "{ipv4} - - GET /", "host={ipv4}"],
    "address": ["She lives at {address}.", "Address: {address}", "They moved to {address}; the old entry is wrong.", "Send the papers to {address}.", "Our office is at {address}.", "{address}", "Deliver to {address}, please.", "Visiting address: {address}", "Meet me at {address} at noon.", "billing address {address}", "The house at {address} was sold.", "Ship to: {address}"],
    "": ["{name}, {phone}, {email}", "Name: {name}, Tel: {phone}", "{name} <{email}>", "{name} lives at {address}.", "Contact {name} at {email} or {phone}.", "{name} ({email}) logged in from {ipv4}.", "Patient {name}, SSN {ssn}, phone {phone}.", "{name} paid with {credit_card}.", "Passport {id_number} belongs to {name}."],
    "none": [
        "We opened {thing} in {year}.", "{thing} was rebuilt twice.", "I read {thing} yesterday.", "According to {thing}, prices rose.", "Part no. {serial} is out of stock.", "Order {serial} was shipped on {date}.", "Invoice {serial} is in the archive.", "Ticket #{serial} is a copy.", "Version {version} and newer.", "It costs ${n} or {n}.{n} euros.",
        "Room {n}, floor {n}", "See {thing} for more.", "at {time} on {date}", "ISBN {isbn}", "Chapter {n} explains {thing}.", "The {thing} team met at noon.", "{n} of {n} tests passed", "commit {hash}", "released by {thing}", "thanks to {thing}", "visit https://www.{host}/p/{n}", "serial number {serial}", "build {version} failed", "Meet us at {thing} at {time}.", "tracking code {serial}", "@{word} liked this", "Look at {word} at home.", "The population is {big}.", "Photo: {thing}", "{thing} said that sales fell.", "Dear customer, thank you.", "Please contact support.", "The committee asked {thing} to reply.", "User guide by {thing}", "lot {serial} expires {date}", "on {date}", "{date}, {time}", "due {date}", "The total is {big}.", "{big} people live here.", "the {date} session at {time}", "expires {date}", "batch {version}", "Section {version} of the manual", "firmware {version} is out",
    ],
}
_DE = {
    "name": ["{name} kam zu spät.", "Ich habe mit {name} gesprochen.", "Herr {name} ist im Urlaub.", "Frau {name} hat angerufen.", "Frau Dr. {name} hat den Entwurf gelesen.", "Mit freundlichen Grüßen {name}", "Geprüft von {name}.", "Autor: {name}", "Ansprechpartner: {name}", "Laut {name} stimmt das nicht.", "Sehr geehrter Herr {name},", "der Leiter {name} sagte zu", "Liebe {name}, danke!", "Foto: {name}", "Das Buch von {name} ist gut.", "{name} und {name} gewannen.", "{name} und {name} kamen."],
    "email": ["Schreiben Sie an {email}.", "E-Mail: {email}", "Kontakt: {email}", "Antworten bitte an {email} schicken.", "Meine Adresse lautet {email}.", "Anmeldung unter {email}"],
    "phone": ["Telefonisch unter {phone} erreichbar.", "Tel.: {phone}", "Rufen Sie {phone} an.", "Handy {phone}", "Meine Nummer ist {phone}.", "Telefon {phone}, vormittags"],
    "id_number": ["Ausweisnummer {id_number} wurde notiert.", "Reisepass Nr. {id_number}", "Personalausweis {id_number}", "Passnummer: {id_number}"],
    "credit_card": ["Bezahlt mit Karte {credit_card}.", "Kreditkarte: {credit_card}", "Kartennummer {credit_card}"],
    "ipv4": ["Anmeldung von {ipv4}.", "Der Server {ipv4} antwortet nicht.", "IP-Adresse {ipv4}"],
    "address": ["Die Anschrift lautet {address}.", "Post bitte an {address}.", "Er wohnt in der {address}.", "Adresse: {address}", "Unser Büro: {address}"],
    "none": ["Die {thing} ist geschlossen.", "Rechnung {serial} vom {date}", "Bestellung {serial} ist unterwegs.", "Laut {thing} steigt der Preis.", "Artikelnummer {serial}", "Kapitel {n} und {n}", "bis {date}", "{date}, {time} Uhr", "Es sind {big} Euro.", "Version {version} ist neu.", "Am {date} um {time} Uhr", "Der Rat der Stadt tagte lange.", "Mit freundlichen Grüßen Ihr Team", "Vorgang {serial} ist offen."],
}
_FR = {
    "name": ["{name} est arrivé hier.", "J'ai parlé avec {name}.", "M. {name} est absent.", "Mme {name} a corrigé le texte.", "Relu par {name}.", "Cordialement, {name}", "Auteur : {name}", "Selon {name}, c'est faux.", "Le livre de {name} est bon.", "Cher {name}, merci.", "Monsieur {name} habite ici.", "Photo : {name}", "le docteur {name} a signé", "{name} et {name} ont gagné.", "{name} et {name} sont venus.", "entre {name} et {name}"],
    "email": ["Écrivez à {email}.", "Écrire à {email} en cas de doute.", "Courriel : {email}", "Mon adresse est {email}.", "Contactez {email} pour l'accès."],
    "phone": ["Appelez le {phone}.", "Tél. {phone}", "Joignable au {phone} le matin.", "Mon numéro est le {phone}.", "Téléphone : {phone}"],
    "id_number": ["Passeport n° {id_number}", "Pièce d'identité n° {id_number}", "Numéro de sécurité sociale {id_number}", "carte d'identité {id_number}"],
    "credit_card": ["Payé par carte {credit_card}.", "Carte bancaire : {credit_card}", "numéro de carte {credit_card}"],
    "ipv4": ["La connexion depuis {ipv4} a échoué.", "Adresse IP : {ipv4}", "Le serveur {ipv4} ne répond pas."],
    "address": ["Il habite au {address}.", "Adresse : {address}", "Envoyez le dossier au {address}.", "Notre bureau : {address}", "Livraison au {address}"],
    "none": ["Le {thing} est fermé.", "Facture {serial} du {date}", "Commande {serial} expédiée", "Selon {thing}, les prix montent.", "Version {version} disponible", "Chapitre {n}, page {n}", "le {date} à {time}", "La ville a voté hier.", "Réf. {serial}", "Cordialement, l'équipe", "Dossier {serial} clos.", "avant le {date}", "{date} à {time}", "Numéro {serial}"],
}
_ES = {
    "name": ["{name} llegó tarde.", "Hablé con {name} ayer.", "El señor {name} no está.", "La señora {name} corrigió el texto.", "Revisado por {name}.", "Saludos, {name}", "Autor: {name}", "Según {name}, es falso.", "El libro de {name} es bueno.", "Estimado {name}:", "Foto: {name}", "la doctora {name} firmó", "{name} y {name} ganaron.", "{name} y {name} vinieron."],
    "email": ["Escriba a {email}.", "Correo: {email}", "Contacto: {email}", "Mi dirección es {email}.", "Envíe el archivo a {email} hoy."],
    "phone": ["Llame al {phone}.", "Tel. {phone}", "Mi número es el {phone}.", "Teléfono: {phone}", "móvil {phone}, por la tarde"],
    "id_number": ["Documento de identidad {id_number}", "DNI {id_number}", "Pasaporte n.º {id_number}", "con NIE {id_number}"],
    "credit_card": ["Pagado con la tarjeta {credit_card}.", "Tarjeta: {credit_card}", "número de tarjeta {credit_card}"],
    "ipv4": ["El acceso vino de {ipv4}.", "Dirección IP: {ipv4}", "El servidor {ipv4} no responde."],
    "address": ["Vive en {address}.", "Dirección: {address}", "Envíe los papeles a {address}.", "Nuestra oficina: {address}", "Entrega en {address}"],
    "none": ["El {thing} está cerrado.", "Factura {serial} del {date}", "Pedido {serial} enviado", "Según {thing}, suben los precios.", "Versión {version} disponible", "Capítulo {n}, página {n}", "el {date} a las {time}", "La ciudad votó ayer.", "Ref. {serial}", "Saludos, el equipo", "Expediente {serial} cerrado.", "antes del {date}", "{date}, {time}", "Número {serial}"],
}
_ZH = {
    "han": ["{han}老师修改了草稿。", "本页由{han}审核。", "联系人:{han}", "{han}昨天来过。", "我和{han}谈过了。", "作者:{han}", "{han}先生不在。", "根据{han}的说法,这不对。", "请找{han}办理。", "患者{han},男", "{han}女士您好", "{han}先生来电", "{han}同学参加了比赛", "与{han}联系", "主讲人:{han}", "医生{han}说", "感谢{han}的帮助。", "由{han}负责。"],
    "email": ["邮箱:{email}", "请联系{email}处理。", "发送到{email}即可。", "电子邮件 {email}", "有问题写信给{email}。"],
    "phone": ["电话{phone},上午接听。", "致电{phone}即可。", "手机:{phone}", "联系电话 {phone}", "请拨打{phone}咨询。", "拨打 {phone} 预约", "热线{phone}", "咨询电话:{phone}", "打{phone}找我"],
    "id_number": ["身份证号{id_number}已登记。", "身份证:{id_number}", "护照号码 {id_number}", "证件号{id_number}有误。", "证件号码:{id_number}", "证件 {id_number} 已核对", "凭身份证{id_number}领取"],
    "credit_card": ["付款卡号{credit_card}。", "银行卡:{credit_card}", "卡号 {credit_card} 已失效"],
    "ipv4": ["登录来自{ipv4}。", "IP地址:{ipv4}", "服务器{ipv4}没有响应。"],
    "address": ["地址:{address}", "请寄到{address}。", "他住在{address}。", "收货地址 {address}"],
    "none": ["订单{serial}已发货。", "版本{version}可用。", "会议在{time}开始。", "发票号{serial}", "第{n}章第{n}节", "共有{n}人参加。", "编号{serial}的文件", "公司在{date}成立。", "请阅读说明书。", "价格是{n}元。", "{date}发布", "文件编号{serial}", "编号:{serial}", "序列号{serial}", "订单号:{serial}"],
}
LANGUAGES = {"en": _EN, "de": _DE, "fr": _FR, "es": _ES, "zh": _ZH}


def carriers(held: bool) -> dict[str, list[tuple[str, str]]]:
    """(language, carrier) by group: those held out, or the others."""
    out: dict[str, list[tuple[str, str]]] = {}
    for language, groups in LANGUAGES.items():
        for group, lines in groups.items():
            for i, line in enumerate(lines):
                # groups of three or fewer lose none, so that every kind is trained in every language
                if (i % HELD == HELD - 1 or len(lines) < HELD and len(lines) > 3 and i == len(lines) - 1) == held:
                    out.setdefault("name" if group == "han" else group, []).append((language, line))
    return out


class Maker:
    """Makes values of each kind, and sentences that hold them."""

    def __init__(self, rng: random.Random, held: bool = False) -> None:
        self.rng, self.lines = rng, carriers(held)

    def digits(self, shape: str) -> str:
        """# a digit, % one from 1 to 9, ^ a capital, ~ a digit or capital; other characters stay."""
        r = self.rng
        return "".join(r.choice("0123456789") if c == "#" else r.choice("123456789") if c == "%" else r.choice(string.ascii_uppercase) if c == "^" else r.choice(string.ascii_uppercase + "0123456789" * 2) if c == "~" else c for c in shape)

    def syllables(self, n: int) -> str:
        r = self.rng
        return "".join(r.choice(["b", "br", "c", "d", "dr", "f", "g", "h", "j", "k", "kl", "l", "m", "n", "p", "pr", "r", "s", "st", "t", "tr", "v", "w", "z"]) + r.choice("aaeeiioouy") for _ in range(n)) + r.choice(["", "n", "r", "s", "k", "l", "ch", "tt"])

    def surname(self) -> str:
        r = self.rng
        last = r.choice(SURNAMES) if r.random() < 0.6 else self.syllables(r.choice([1, 2, 2, 3])).capitalize()
        if r.random() < 0.06:
            last += "-" + r.choice(SURNAMES)
        if r.random() < 0.07:
            last = r.choice(["van ", "von ", "de ", "da ", "di ", "del ", "van der ", "Le ", "Al-", "Mac", "O'"]) + last
        return last

    def name(self, language: str = "en") -> str:
        r = self.rng
        if language == "zh" and r.random() < 0.85:
            return r.choice(HAN_SURNAMES) + "".join(r.choice(HAN_GIVEN) for _ in range(r.choice([1, 2, 2])))
        first = r.choice(GIVEN) if r.random() < 0.75 else self.syllables(2).capitalize()
        if r.random() < 0.05:
            first += "-" + r.choice(GIVEN)
        last = self.surname()
        initial = r.choice(string.ascii_uppercase) + "."
        out = r.choices([f"{first} {last}", f"{last}, {first}", f"{initial} {last}", f"{first} {initial} {last}", f"{first} {r.choice(GIVEN)} {last}", f"{last}, {first} {initial}", f"{first} {last} {r.choice(SURNAMES)}"], [70, 7, 8, 6, 4, 2, 3 if language != "es" else 15])[0]
        return r.choices([out, out.upper(), out.lower()], [90, 5, 5])[0]

    def email(self, _: str = "en") -> str:
        r = self.rng
        first, last = r.choice(GIVEN).lower(), (r.choice(SURNAMES) if r.random() < 0.5 else self.syllables(2)).lower()
        first, last = (re.sub(r"[^a-z]", "", w) or "x" for w in (first, last))
        n = str(r.randrange(1000))
        local = r.choice([f"{first}.{last}", f"{first[0]}{last}", f"{first}{n}", f"{last}_{first[0]}", f"{last}-{n}", f"{first}.{last}+{r.choice(DOMAINS)}", first, f"{first}_{last}{n}", f"{r.choice(DOMAINS)}", f"{first[0]}.{last}", f"info", f"{last}%{n}"])  # noqa: F541
        host = r.choice([r.choice(DOMAINS), self.syllables(2), self.syllables(3), f"{self.syllables(1)}-{self.syllables(2)}", f"{r.choice(DOMAINS)}.{self.syllables(2)}", "foo", "gmail"]) + r.choice(ENDINGS)
        if r.random() < 0.08:
            local, host = local.upper(), host.upper()
        way = r.random()
        if way < 0.74:
            return f"{local}@{host}"
        at = r.choice(["[at]", "(at)", " [at] ", " (at) ", " at ", " at "])
        return local + at + host.replace(".", r.choice(["[dot]", "(dot)", ".", " [dot] "]) if at != " at " else " dot ")

    def phone(self, _: str = "en") -> str:
        r = self.rng
        return self.digits(r.choice([
            "+1 %## ### ####", "+1-%##-###-####", "(%##) ###-####", "%##-###-####", "%##.###.####", "%## ### ####", "+1 (%##) ###-####", "1-800-###-####", "+1%##########"[:12], "+44 20 #### ####", "020 #### ####", "07### ######", "+44 7### ######", "01## ### ####",
            "+49 30 ########", "+49 ### #######", "030/########", "(030) ########", "0171 #######", "0### ######", "030/#####-###", "+49 (0)89 ######", "+33 % ## ## ## ##", "0% ## ## ## ##", "0%.##.##.##.##", "0033 % ## ## ## ##", "0%########", "+34 6## ### ###", "6## ## ## ##", "9## ### ###", "+34 9########",
            "1%#########", "13#-####-####", "+86 13# #### ####", "010-########", "021 #### ####", "+86 1##########", "###-####", "+4# ## ### ## ##", "+31 6 ########", "+39 0# #### ####", "+81 #-####-####", "+91 ##### #####", "00## ### ######",
        ]))

    def ssn(self, _: str = "en") -> str:
        return self.digits(self.rng.choice(["###-##-####"] * 6 + ["### ## ####", "#########"]))

    def id_number(self, language: str = "en") -> str:
        shapes = {"en": ["^########", "^^#######", "#########", "^^ ## ## ## ^", "^^######^", "^#######", "^^-######"], "de": ["~^#~##~#~"[:9], "^##~~#~##", "^#########", "########-^", "^~#^~##~#"], "fr": ["# ## ## ## ### ###", "# ## ## ## ### ### ##", "##^^#####", "############"], "es": ["########^", "########-^", "^#######^", "^-#######-^", "^^^######"], "zh": ["#################X", "##################", "##################", "^########"]}
        own = self.rng.choice(shapes[language] if self.rng.random() < 0.8 else shapes["en"])
        return self.digits(own)

    def credit_card(self, _: str = "en") -> str:
        return self.digits(self.rng.choice(["%### #### #### ####", "%###-####-####-####", "%###############", "3### ###### #####", "4### #### #### ####", "5###############", "3###-######-#####", "62## #### #### ####"]))

    def ipv4(self, _: str = "en") -> str:
        r = self.rng
        return (r.choice(["."] * 12 + ["[.]"])).join(str(r.choice([10, 172, 192, 203, 198, 127, 255, r.randrange(256), r.randrange(256)]) if i == 0 else r.choice([0, 1, 168, r.randrange(256), r.randrange(256)])) for i in range(4))

    def address(self, language: str = "en") -> str:
        r = self.rng
        n, town = str(r.randrange(1, r.choice([30, 200, 3000]))) + r.choice([""] * 9 + ["a", "b"]), r.choice(TOWNS) if r.random() < 0.6 else self.syllables(2).capitalize()
        if language == "de":
            street = r.choice(DE_STREETS) + r.choice(["straße", "str.", "weg", "allee", "gasse", "platz"]) if r.random() < 0.7 else r.choice(["Am ", "An der ", "Im ", "Alte "]) + r.choice(DE_STREETS) + r.choice(["", "graben", "hof"])
            return f"{street} {n}, {self.digits('#####')} {town}"
        if language == "fr":
            kind = r.choice(["rue", "avenue", "boulevard", "place", "chemin", "impasse", "allée", "quai"])
            return f"{n}{r.choice(['', '', '', ' bis', ' ter'])}{r.choice([' ', ', '])}{kind} {r.choice(['', 'de la ', 'du ', 'des '])}{r.choice(FR_STREETS)}, {self.digits('#####')} {town}"
        if language == "es":
            kind = r.choice(["Calle", "C/", "Avenida", "Avda.", "Paseo", "Plaza", "Calle de"])
            return f"{kind} {r.choice(ES_STREETS)}{r.choice([' ', ', '])}{n}{r.choice(['', '', ', 2.º B', ', 3º izq.'])}, {self.digits('#####')} {town}"
        if language == "zh":
            return f"{r.choice(HAN_TOWNS) if r.random() < 0.7 else ''}{r.choice(HAN_AREAS) if r.random() < 0.6 else ''}{r.choice(HAN_STREETS)}{r.randrange(1, 999)}号{r.choice(['', '', str(r.randrange(1, 30)) + '栋', str(r.randrange(100, 2000)) + '室'])}"
        if r.random() < 0.12:
            return f"{r.choice(['P.O. Box', 'PO Box'])} {r.randrange(1, 30000)}, {town}{r.choice(['', self.digits(' #####')])}"
        street = f"{n} {(r.choice(EN_STREETS) if r.random() < 0.7 else self.syllables(2).capitalize())} {r.choice(EN_KINDS)}"
        inside = r.choice(["", "", "", f", Apt {r.randrange(1, 90)}", f", Suite {r.randrange(1, 900)}", f" #{r.randrange(1, 40)}"])
        front = r.choice([""] * 6 + [f"Flat {r.randrange(1, 60)}, "])
        code = r.choice(["", self.digits(" #####"), self.digits(", ^^ #####"), self.digits(" ^^% %^^"), self.digits(" ^# #^^"), ", " + self.digits("^^"), self.digits(", ^^# #^^")])
        return f"{front}{street}{inside}, {town}{code}"

    def other(self, slot: str) -> str:
        r = self.rng
        if slot == "thing":
            return r.choice(THINGS) if r.random() < 0.75 else f"{self.syllables(2).capitalize()} {r.choice(['Ltd', 'Group', 'Report', 'Index', 'Museum', 'Valley', 'Bridge', 'School', 'Party', 'Act', 'Prize', 'Records', 'Systems', 'GmbH', 'Verlag'])}"
        if slot == "serial":
            return self.digits(r.choice(["###-##-####", "######", "########", "^^-#####", "####-####-#####", "################", "#### #### ####", "~~~~~~~~", "###########", "^###", "20##-####", "#########", "## ### ###", "####-####"]))
        if slot == "date":
            return self.digits(r.choice(["20##-0%-1#", "1#/0%/20##", "%. Mai 20##", "% June 19##", "1#.0%.20##"]))
        if slot == "version":
            return self.digits(r.choice(["%.#", "%.#.#", "%.##.#.##", "v%.#.#", "%.%.%#", "%.#.#.#"]))
        made = {"year": "19##", "time": "1#:#0", "n": r.choice(["%", "%#", "%##"]), "isbn": "978-#-##-######-#", "big": "%#,###,###"}
        if slot in made:
            return self.digits(made[slot])
        if slot == "hash":
            return "".join(r.choice("0123456789abcdef") for _ in range(r.choice([7, 12, 40])))
        return self.syllables(2) + (".com" if slot == "host" else "")

    def fill(self, language: str, line: str) -> tuple[str, list[tuple[int, int, str]]]:
        out, spans, at = "", [], 0
        for m in re.finditer(r"\{(\w+)\}", line):
            out += line[at : m.start()]
            slot = "name" if m[1] == "han" else m[1]
            personal = slot in ("name", "email", "phone", "ssn", "id_number", "credit_card", "ipv4", "address")
            body = getattr(self, slot)(language) if personal else self.other(slot)
            if personal:
                spans.append((len(out), len(out) + len(body), slot))
            out += body
            at = m.end()
        return out + line[at:], spans

    def loosened(self, line: str, words: list[str], share: float) -> str:
        """A carrier with some of its words replaced by any others, or left out, so that none is needed."""
        r = self.rng
        out = []
        for w in line.split(" "):
            if "{" not in w and r.random() < share:
                if r.random() < 0.3:
                    continue
                other = r.choice(words) if words and r.random() < 0.8 else self.syllables(r.choice([1, 2, 3]))
                w = (other.capitalize() if w[:1].isupper() else other) + (w[-1] if w[-1:] in ".,:;!?" else "")
            out.append(w)
        return " ".join(out)

    def sentence(self, neutral: list[str], plain: float = 0.25) -> tuple[str, list[tuple[int, int, str]]]:
        """A carrier, alone or between neutral sentences or marks of markup; or a value among any words."""
        r = self.rng
        words = [w.strip(".,;:!?()") for w in r.choice(neutral).split()] if neutral else []
        words = [w for w in words if w.isalpha()]
        group = "none" if r.random() < plain else r.choices(list(self.lines), [5 if g == "name" else 2 for g in self.lines])[0]
        language, line = r.choice(self.lines[group])
        if language != "zh" and r.random() < 0.6:
            line = self.loosened(line, words, 0.15 if group in ("ssn", "id_number", "credit_card", "none") else 0.4)
        elif language != "zh" and words and r.random() < 0.3:
            i = r.randrange(len(words) + 1)
            slot = r.choice(["name", "name", "email", "ipv4", "address", "thing", "date", "thing", "time", "big"])
            line = " ".join([*words[:i][-6:], "{" + slot + "}" + r.choice(["", "", ",", ".", ":", " -"]), *words[i:][:6]])
        if r.random() < 0.15:
            language = r.choice(list(LANGUAGES))
        text, spans = self.fill(language, line)
        way = r.random()
        if way < 0.12 and neutral:
            text, spans = self._after(r.choice(neutral)[:120] + r.choice([" ", " ", ". ", ": ", " - "]), text, spans)
        elif way < 0.2 and neutral:
            text += r.choice([" ", "; ", " ("]) + r.choice(neutral)[:120]
        elif way < 0.3:
            second, more = self.fill(*r.choice(self.lines[r.choice(list(self.lines))]))
            text, spans = text + " " + second, spans + [(a + len(text) + 1, b + len(text) + 1, k) for a, b, k in more]
        elif way < 0.4:
            front, back = r.choice([("<p>", "</p>"), ("- ", ""), ("* ", ""), ("**", "**"), ("> ", ""), ("<li>", "</li>"), ("| ", " |"), ("\\item ", ""), ("\"", "\""), ("(", ")"), ("user: ", ""), ("1. ", ""), ("", "<br>"), ("== ", " ==")])
            text, spans = self._after(front, text + back, spans)
        return text, spans

    @staticmethod
    def _after(front: str, text: str, spans: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int, str]]]:
        return front + text, [(a + len(front), b + len(front), k) for a, b, k in spans]
