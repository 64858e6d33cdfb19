"""Labelled units that the exemplars were not written from: residue in other wordings, and content that resembles it.

Written after the exemplars of ``gyrolith.llm.exemplars`` and not used to choose them.
"""

RESIDUE = [
    # error pages and failed fetches
    "<html><head><title>504 Gateway Time-out</title></head><body><center><h1>504 Gateway Time-out</h1></center><hr><center>nginx/1.18.0</center></body></html>",
    "429 Too Many Requests. Rate limit exceeded",
    "403 Forbidden\n\nYou don't have access to this resource.",
    "Error 500: Internal Server Error",
    '{"error": {"code": 404, "message": "Not Found"}}',
    '{"detail": "Not found."}',
    '{"timestamp": "2024-01-05T10:00:00Z", "status": 503, "error": "Service Unavailable", "path": "/api/v1/items"}',
    "This page could not be found.",
    "Sorry, the file you are looking for is no longer available.",
    "The document could not be loaded. Please try again in a few minutes.",
    "Something went wrong while loading this page. Please refresh and try again.",
    "Unable to connect to the database.",
    "The server is currently unavailable because it is down for maintenance.",
    "Your session has timed out. Please sign in again to continue.",
    "You must sign in to see this content.",
    "This repository has been archived by the owner.",
    "This link has expired or was deleted.",
    "Oops! We can't find the page you are looking for. Go back to the home page.",
    "Request failed with status code 502",
    "Failed to load notebook. Retry?",
    "Connection refused. The host did not respond.",
    "Access to this resource is denied. Contact your administrator for access.",
    "We are experiencing technical difficulties. Please come back later.",
    "Die Seite konnte nicht gefunden werden.",
    "La page que vous avez demandée est introuvable.",
    "La página solicitada no existe.",
    "Страница не существует или была удалена.",
    # scripts
    "Please turn JavaScript on and reload the page.",
    "We're sorry but app doesn't work properly without JavaScript enabled",
    "JavaScript is required to use this application.",
    "<noscript>This site needs JavaScript to run. Enable it in your browser settings.</noscript>",
    "Your browser has JavaScript turned off. Switch it on to view this chart.",
    "This output cannot be displayed without scripts.",
    "You have disabled scripts; please allow them to see this widget.",
    "Enable JavaScript and cookies to continue",
    "This interactive map requires JavaScript.",
    "Sorry, your browser does not support JavaScript.",
    "Scripts are blocked for this page.",
    "Bitte aktivieren Sie JavaScript in Ihrem Browser.",
    "Veuillez activer JavaScript pour continuer.",
    # templates
    "Add your conclusion here",
    "TODO: describe the dataset",
    "Content coming soon",
    "Hello {name}, welcome to {place}.",
    "[Insert project overview]",
    "# {{ cookiecutter.project_name }}\n\n{{ cookiecutter.description }}",
    "Hi <FIRST_NAME>, thanks for joining <COMPANY>.",
    "Contact: ${email}, phone: ${phone}",
    "Report for %%CUSTOMER%% generated on %%DATE%%",
    "[Your Name]\n[Your Title]\n[Date]",
    "Write a brief summary of your results here.",
    "Describe your approach in two or three sentences.",
    "Replace this text with your own introduction.",
    "Explain your answer here.",
    "(insert figure here)",
    "Title goes here",
    "Placeholder for the discussion section",
    "Type your notes here...",
    "TBD: methods",
    "Fill in the table below.",
    "This section will be completed later.",
    "Inserte su texto aquí",
    "Bitte Text hier eingeben",
    # filler
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.",
    "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.",
    "Lorem ipsum ferax novus dolor amet umbra solis et terra.",
    "Foo bar baz. Foo bar. Baz qux.",
    "blah blah blah blah",
    "xxxxx xxx xxxxx",
    "text text text text text",
    "The quick brown fox jumps over the lazy dog. The quick brown fox jumps over the lazy dog.",
]

CONTENT = [
    "# Title",
    "Summary",
    "Project description",
    "Page not found errors are counted per site in the table below, grouped by week.",
    "The fetcher sees a short page asking readers to enable JavaScript, so we wait.",
    "HTTPError: HTTP Error 404: Not Found",
    "Loading the data",
    "[INFO] step 3 done",
    "Table of contents",
    "Results and discussion",
    "Use `{{ name }}` in the page to print the variable",
    "12 13 14",
    "The mean of the residuals",
    "Error rate by section",
    "Load the dataset",
    "We load the page scores and plot them by month.",
    "Description of the model and its parameters",
    "Traceback (most recent call last):\n  File \"a.py\", line 3, in <module>\nValueError: could not convert string to float: 'x'",
    "ConnectionError: HTTPSConnectionPool(host='example.org', port=443): Max retries exceeded with url: /data.csv",
    "FileNotFoundError: [Errno 2] No such file or directory: 'data.csv'",
    "The proxy returned 502 for about one request in a thousand, mostly at night.",
    "A placeholder such as <NAME> stands for the name of the column to be read.",
    "Templates in Jinja use double braces, as in `{{ user.name }}`, and blocks in `{% if %}`.",
    "Lorem ipsum has been the printing trade's filler text since the sixteenth century.",
    "This function is deprecated and will be removed in version 3.",
    "Warning: the file already exists and will be overwritten.",
    "Download finished in 3.2 seconds.",
    "Epoch 1/10 loss 0.532 accuracy 0.81",
    "Next, we enable logging and run the script again.",
    "We then remove rows with missing values and save the table.",
    "Exercise 3: compute the determinant of the matrix above and explain what its sign means.",
    "The access log shows who opened which report and when.",
    "In this chapter we describe the methods used to collect the samples.",
    "Your model should now reach an accuracy of about 90 percent.",
    "Click on the bar to see the values of a single month.",
    "Introduction",
    "Data and methods",
    "JavaScript and Python differ in how they treat missing keys.",
    "The script reads the file, drops duplicates and writes a report.",
    "Permission was asked of all owners before their records were used.",
    "Status codes of the API: 200 means success, 404 a missing item, 503 an overloaded server.",
    "pandas.errors.EmptyDataError: No columns to parse from file",
    "array([[0., 1.], [1., 0.]])",
    "<class 'numpy.ndarray'>",
    "None",
    "True",
    "Name: price, dtype: float64",
    "count 100.0 mean 3.1 std 0.4",
    "The server answered every request within a second after the index was rebuilt.",
    "Add the two columns and divide by the total to get the share.",
    "Note that the figure shows only the first hundred points.",
    "Write the results to a CSV file",
    "Try again with a smaller learning rate and compare the curves.",
    "Sign test of the paired differences",
    "Visible light and noise by sensor",
    "A brown fox was seen near the station in March.",
]

#: A second set, written after the exemplars were extended for what the first one showed, and used for nothing but measuring.
RESIDUE_2 = [
    "<html><body><h1>Not Found</h1><p>The requested URL /old/index.html was not found on this server.</p></body></html>",
    "401 Unauthorized: authentication required",
    "Error code 1020. Access denied.",
    '{"message": "Bad gateway", "code": 502}',
    "The page has moved. Please check the address and try again.",
    "This video is private.",
    "We could not find that user.",
    "The notebook viewer is offline for maintenance. Please check back soon.",
    "An error occurred while rendering this cell.",
    "Sorry, you need permission to view this project. Ask the owner for access.",
    "Your request was blocked. Reference id 8a7f3c2e11",
    "Upstream request timeout",
    "Nothing was found here. Return to the home page?",
    "This service is not available in your region.",
    "Daten konnten nicht geladen werden. Bitte versuchen Sie es später noch einmal.",
    "Ce document n'existe plus ou a été supprimé.",
    "JavaScript appears to be disabled. Please enable it to use the viewer.",
    "This widget needs scripts to run.",
    "For full functionality of this page, JavaScript must be switched on.",
    "Scripting is off in this viewer, so the chart is hidden.",
    "Allow scripts for this site and refresh.",
    "Esta aplicación requiere JavaScript.",
    "Your description here",
    "Enter your name and student id below.",
    "Insert a figure of your results here.",
    "Put your code here",
    "Add a title",
    "Dear {{customer}}, your order {{order_id}} has shipped.",
    "[PROJECT NAME]: [ONE LINE DESCRIPTION]",
    "Draft. Text to be added.",
    "Summarize the paper in your own words.",
    "Replace with a short biography of the author.",
    "Signed: <YOUR NAME>, $DEPARTMENT_NAME$",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris.",
    "Lorem ipsum lorem ipsum lorem ipsum",
    "foo foo bar bar baz",
]

CONTENT_2 = [
    "Conclusion",
    "Model access and permissions",
    "The page views of the site fell in May and rose again in June.",
    "We could not find a link between noise and light.",
    "The request was answered in 40 ms on average.",
    "KeyError: 'name'",
    "ModuleNotFoundError: No module named 'torch'",
    "A JavaScript engine runs each script in its own frame, which is why the second call is slower.",
    "Use <b>name</b> to mark the column.",
    "The format string '{value}' prints the value with all digits.",
    "Requests with status 404 are removed before the counts are made.",
    "In the next section we describe the data in more detail.",
    "Your turn: change the window to 20 and run the cell again.",
    "The description is short and the title is missing in twelve records.",
    "x y z",
    "Latin names such as Quercus alba are kept as they are.",
    "Saved figure to results/plot.png",
    "Done.",
    "train 800 test 200",
    "This example shows how to read a file in chunks.",
    "If the service is down the client waits and tries the other host.",
    "Names and addresses were replaced before the survey was shared.",
    "References",
    "Methods",
    "The author thanks the reviewers for their comments.",
]

#: A third set, written after all thresholds were set; nothing was changed for it.
RESIDUE_3 = [
    "<h1>Error 403</h1><p>You are not authorized to view this page.</p>",
    "HTTP 408 Request Timeout",
    "410 Gone\nThis article has been removed.",
    '{"status": 500, "error": "Internal Server Error"}',
    "This image cannot be displayed.",
    "The link is broken. Go back to the previous page.",
    "We are down for scheduled maintenance and will be back shortly.",
    "You have been logged out. Please log in again.",
    "Preview not available for this file.",
    "Too many requests, please wait a few seconds and retry.",
    "No connection to the server. Reload the page or check your network.",
    "The dataset page you requested has been deleted by its owner.",
    "Sorry! The dashboard could not be reached.",
    "Resource not found.",
    "Network error: unable to load content.",
    "Fehler 404: Dokument nicht gefunden",
    "Impossible de charger la page. Veuillez réessayer plus tard.",
    "To see this plot, enable JavaScript.",
    "JavaScript is blocked. Allow it and reload.",
    "This page works only with JavaScript turned on.",
    "You are seeing this message because your browser does not run scripts.",
    "Widgets cannot be shown: scripts are disabled in this viewer.",
    "JavaScript está desactivado en su navegador.",
    "Pour utiliser ce site, veuillez activer JavaScript.",
    "Add a short description of the experiment.",
    "Your name, your affiliation, your email",
    "Write your hypothesis here.",
    "Type a title",
    "Describe the figure above in your own words.",
    "Section to be written",
    "Welcome to {{ site_name }}! Today is {{ date }}.",
    "<PROJECT_NAME> is licensed under <LICENSE>.",
    "Name: [NAME]\nDate: [DATE]\nGroup: [GROUP]",
    "Delete this text and insert your abstract.",
    "Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit.",
    "qwerty asdf asdf qwerty",
]

CONTENT_3 = [
    "Discussion",
    "File formats",
    "Paths and keys of the store",
    "The chart above shows how many pages were served per hour.",
    "We found no error in the second run.",
    "TypeError: unsupported operand type(s) for +: 'int' and 'str'",
    "TimeoutError: timed out",
    "The browser sends the cookie with each request.",
    "Do not enable caching before the first run.",
    "The word lorem is Latin only in part.",
    "The notebook opens the connection, reads a page of records and closes it.",
    "Add a row for each sensor and sort by time.",
    "Describe() gives the count, mean and deviation of each column.",
    "{'name': 'a', 'title': 'b'}",
    "Loss fell after the third step.",
    "We deleted records that had moved to the archive.",
    "Error bars show one standard deviation.",
    "Summary of the results by group and date",
    "Insert sort is quadratic.",
    "The server log holds the status of each request.",
    "Test passed.",
    "Processing file 3 of 10",
    "date group value",
    "Owners of older devices see slower pages.",
    "The next page lists the names of all contributors.",
]
