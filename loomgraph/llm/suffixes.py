"""Suffixes of several labels under which names are registered, as data. Others have one label.

The usual second-level suffixes of countries, and hosters whose customers are sites of
their own. A caller with the full public list passes it instead: it is one parameter.
"""

_BY_COUNTRY = """
ae ac co gov net org|ar com edu gob gov net org|at ac co gv or|au asn com edu gov id net org|bd com edu gov net org|bo com edu gob net org|br com edu eco gov jus leg mil net org
cn ac com edu gov net org|co com edu gov net nom org|cr ac co ed fi go or|cy com gov net org|do com edu gob net org|ec com edu fin gob net org|eg com edu gov net org|es com edu gob nom org
fr asso com gouv nom|gh com edu gov org|gr com edu gov net org|gt com edu gob net org|hk com edu gov idv net org|hu co info org|id ac co desa go mil my net or sch web
il ac co gov k12 muni net org|in ac co edu firm gen gov ind net nic org res|it edu gov|jp ac ad co ed go gr lg ne or|ke ac co go me ne or sc|kr ac co es go hs kg ms ne or pe re sc
kw com edu gov net org|kz com edu gov net org|lb com edu gov net org|lk ac com edu gov net org|ma ac co gov net org|mx com edu gob net org|my com edu gov name net org
ng com edu gov name net org sch|np com edu gov net org|nz ac co geek gen govt iwi kiwi maori net org school|pe com edu gob net nom org|ph com edu gov net ngo org
pk com edu fam gob gok gov net org web|pl com edu gov info net org|pt com edu gov org|py com coop edu gov net org|qa com edu gov net org|ro com info nom org store
rs ac co edu gov in org|ru ac com edu gov int msk net org pp spb|sa com edu gov med net org sch|sg com edu gov net org per|th ac co go in mi net or|tr av bbs bel biz com dr edu gen gov info k12 name net org pol tel tv web
tw club com ebiz edu game gov idv net org|tz ac co go me ne or sc|ua com edu gov in kiev kyiv lviv net odessa org|ug ac co com go ne or org sc|uk ac co gov ltd me net nhs org plc police sch
uy com edu gub mil net org|ve co com edu gob info net org web|vn ac biz com edu gov health info name net org pro|za ac co edu gov law mil net nom org school web|zw ac co gov org
"""
_HOSTERS = """
appspot.com azurewebsites.net bitbucket.io blogspot.com cloudfront.net de.com eu.com eu.org firebaseapp.com fly.dev github.io githubusercontent.com gitlab.io glitch.me herokuapp.com myshopify.com
neocities.org netlify.app onrender.com pages.dev readthedocs.io surge.sh translate.goog uk.com us.com vercel.app web.app weeblysite.com wordpress.com workers.dev
blogspot.co.uk blogspot.com.au blogspot.com.br blogspot.com.es s3.amazonaws.com
"""

SUFFIXES = tuple(sorted({f"{part}.{c[0]}" for c in map(str.split, _BY_COUNTRY.replace("\n", "|").split("|")) if c for part in c[1:]} | set(_HOSTERS.split())))
